"""Running values over groups of any size, one way for all of them.

A window puts a whole group into one task, which is too much for one that holds a
third of all rows.  So the rows are put in the order of keys and values, in ranges
of about equal size: a large group, or a single instant with many rows, then covers
several of them.  The ranges are written once, because they must be the same for
all that follows.  Each group's part of a range is summarised, the short list of
summaries is accumulated, and a part needs only its own rows plus what is carried
in from the parts before it.  Nulls are a group like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_over


def _in_ranges(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows with ``_range`` and their ``_place`` in it; equal rows may lie in several ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return hand_over(ranged.drop("_tie").withColumns({"_range": F.spark_partition_id(), "_place": place}))


def _with_carry(rows: DataFrame, keys: list[str], parts: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Rows with what the parts of their group before theirs add up to, null in the first."""
    totals = rows.groupBy(*keys, "_range").agg(*[c.alias(n) for n, c in parts.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_range")) == 1
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), first.alias("_first"), *[c.over(before).alias(n) for n, c in carried.items()]
    ).filter(~F.col("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    met = reduce(lambda a, b: a & b, same, F.col("_range") == F.col("_r"))
    return rows.join(carry, met, "left").drop("_r", "_first", *[f"_k_{k}" for k in keys])


def _inside(keys: list[str]):
    return Window.partitionBy("_range", *keys).orderBy("_place")


def _upto(keys: list[str]):
    return _inside(keys).rowsBetween(Window.unboundedPreceding, 0)


def running_sums(rows: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Each of ``sums`` up to and including the row."""
    ranged = _in_ranges(rows.withColumns({f"_v_{out}": v for out, v in sums.items()}), keys, order)
    parts = {f"_p_{out}": F.sum(f"_v_{out}") for out in sums}
    carries = {f"_c_{out}": F.sum(f"_p_{out}") for out in sums}
    done = _with_carry(ranged, keys, parts, carries)
    totals = {out: F.coalesce(F.col(f"_c_{out}"), F.lit(0)) + F.sum(f"_v_{out}").over(_upto(keys)) for out in sums}
    return done.withColumns(totals).drop("_range", "_place", *[f"_v_{o}" for o in sums], *carries)


def row_numbers(rows: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """``out`` = 1, 2, 3 … per group without gaps."""
    return running_sums(rows, keys, order, {out: F.lit(1).cast("long")})


def previous_value(rows: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    """``out`` = ``value`` of the row before, null or not, also across ranges."""
    ranged = _in_ranges(rows, keys, order)
    done = _with_carry(ranged, keys, {"_last": F.max_by(F.struct(value), "_place")}, {"_carry": F.last("_last")})
    first = F.row_number().over(_inside(keys)) == 1
    before = F.when(first, F.col("_carry")[value]).otherwise(F.lag(value).over(_inside(keys)))
    return done.withColumn(out, before).drop("_range", "_place", "_carry")


def running_max(rows: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    """``out`` = greatest ``value`` up to and including the row; nulls do not count."""
    done = _with_carry(_in_ranges(rows, keys, order), keys, {"_most": F.max(value)}, {"_carry": F.max("_most")})
    inside = F.max(value).over(_upto(keys))
    return done.withColumn(out, F.greatest(F.col("_carry"), inside)).drop("_range", "_place", "_carry")
