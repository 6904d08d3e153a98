"""Where a user's own fetcher or extractor is plugged in.

The callable sees one task's rows in Arrow batches.  Whatever it raises becomes
a failed row, so one page never fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..config import Field

EXTRACTED = "entity_id long, url string, success boolean, error string, content string"
# rows that are handed on at once, so that few bodies are held
FRAME = 50
FETCHED = "url string, success boolean, status string, data string, cost double, error string"


def extract_with(pages: DataFrame, extractor: Callable, fields: list[Field]) -> DataFrame:
    """Apply ``extractor(text, fields) -> dict`` to every page.

    Filter ``pages`` before: nothing is pushed below a Python step.
    """
    wanted = list(fields)

    def one(text):
        try:
            return True, None, json.dumps(extractor(text, wanted))
        except Exception as e:  # noqa: BLE001
            return False, f"{type(e).__name__}: {e}", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), FRAME):
                part = batch.iloc[k : k + FRAME]
                results = [one(t) for t in part["data"]]
                out = pd.DataFrame(results, columns=["success", "error", "content"], index=part.index)
                yield pd.concat([part[["entity_id", "url"]], out], axis=1)

    return pages.select("entity_id", "url", "data").mapInPandas(run, EXTRACTED)


def fetch_with(links: DataFrame, fetcher: Callable, concurrent: int, given: str | None = None) -> DataFrame:
    """Apply ``fetcher([url]) -> [dict]`` with at most ``concurrent`` tasks at a time.

    With ``given``, a column of ``links`` such as the body of a stored page, the call
    is ``fetcher([url], [value])``.
    """

    def one(url, *values):
        try:
            (row,) = fetcher([url], *[[v] for v in values])
            ready = row.get("status") == "ready"
            return url, ready, row.get("status"), row.get("data"), float(row.get("cost") or 0.0), row.get("error")
        except Exception as e:  # noqa: BLE001
            return url, False, "failed", None, 0.0, f"{type(e).__name__}: {e}"

    columns = ["url", *([given] if given else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), FRAME):
                rows = zip(*[batch[c].iloc[k : k + FRAME] for c in columns])
                yield pd.DataFrame([one(*r) for r in rows], columns=["url", "success", "status", "data", "cost", "error"])

    return links.select(*columns).repartition(concurrent).mapInPandas(run, FETCHED)
