"""Contiguous shards of near equal byte size, from prefix sums.

The table is put in order of its key and written once with, for every row, the
number of its range and its place in that range.  Per-range totals are then
summed up over the ranges (as many rows as there are ranges), so each row knows
how many bytes stand before it in the whole order, and the order is cut where
that sum passes k / n of all bytes.

* Size: UTF-8 bytes of the text (null: none) plus 1.
* Order: key (nulls first), then size and checksum.  Rows equal in all three are
  interchangeable and are told apart by their place in the input, so one key with
  any number of rows is spread over several ranges.
* A row belongs to the shard that holds the middle of its bytes.  Shards thus
  differ by less than the largest row; if one row outweighs a shard, the shards
  it covers stay empty.
* An empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_over, prepare

# rows of one range that are summed by one task
RANGE_ROWS = 2_000_000


def text_size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def _ranges(df: DataFrame) -> int:
    """Ranges: as many as the session shuffles into, more if they would get too long."""
    set_to = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(set_to, -(-df.count() // RANGE_ROWS))


def balanced_shards(docs: DataFrame, n: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot``: slots count from 0 in each shard."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    prepare(docs.sparkSession)
    narrow = docs.select(
        F.col(key),
        text_size(text).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_at"),
    )
    order = [F.col(key).asc_nulls_first(), "size", "text_crc32", "_at"]
    ranged = hand_over(
        narrow.repartitionByRange(_ranges(docs), *order)
        .sortWithinPartitions(*order)
        .drop("_at")
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # one row per range: the only sum in one task, over ranges and not over rows
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_bytes_before") + F.sum("size").over(inside) - F.col("size") / 2
    placed = hand_over(
        ranged.join(offsets, "_range").select(
            key,
            "size",
            "text_crc32",
            F.least(F.floor(middle * n / F.col("_all")), F.lit(n - 1)).cast("int").alias("shard"),
            (F.col("_rows_before") + F.col("_place")).alias("_index"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("_index").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").select(  # n rows
        key, "size", "text_crc32", "shard", (F.col("_index") - F.col("_start")).alias("slot")
    )


def op5(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return balanced_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
