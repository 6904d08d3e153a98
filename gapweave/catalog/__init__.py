"""All registered queries, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ["projections", "relations", "extraction", "storage", "jobs", "streams"]


def _catalogs():
    return [import_module(f"{__name__}.{area}").catalog for area in AREAS]


def queries() -> dict:
    return {name: fn for c in _catalogs() for name, fn in c.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for c in _catalogs() for name, sql in c.oracles.items()}
