"""Stored sketches of distinct values, united over days."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gapweave.operators import gather


@pytest.mark.parametrize("n", [1, 500, 60_000])
def test_error_of_united_sketches(spark, n):
    # every value on two days, so that sums over days would count it twice
    rows = spark.range(2 * n).select((F.col("id") % n).alias("value"), (F.col("id") % 7).alias("day"), F.lit("f").alias("field"))
    got = gather.united_counts(gather.value_sketches(rows, ["field", "day"]), ["field"]).first()
    assert abs(got.distinct_values - n) <= max(n * gather.SKETCH_ERROR, 0.5)
    assert got.n_sketches == rows.select("day").distinct().count()


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("f", 1, None), ("f", 1, "a"), (None, 1, "a"), ("g", 1, None)], "field string, day int, value string")
    got = {r.field: r.distinct_values for r in gather.united_counts(gather.value_sketches(rows, ["field", "day"]), ["field"]).collect()}
    assert got == {"f": 1, None: 1}
    assert gather.united_counts(gather.value_sketches(rows.limit(0), ["field", "day"]), ["field"]).count() == 0
