from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs; the other columns carry names that operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def clashing():
    """``docs`` with extra columns named like results and inner columns."""
    from pyspark.sql import functions as F

    def add(docs):
        names = "score predicted size shard slot bits tid root component_id term pos window ids row nr key start".split()
        return docs.select("*", *[F.lit("x").alias(n) for n in names])

    return add


def words_of(text):
    return text.lower().split() if text else []
