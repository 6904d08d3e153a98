"""A page store that is put into buckets of its links once, so that bodies are not shuffled again.

``save_store`` writes a table with one sorted file for each bucket; Spark knows the
buckets, so a join on the link sends only the other side to them.  ``catalog_table``
keeps any table under a name in the production or test schema.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one bucket should hold, a task's work.
BUCKET_BYTES = 256 << 20
SCHEMAS = {"prod": "production", "test": "test"}


def schema_name(mode: str = "test") -> str:
    """Production and test tables live apart; anything but ``prod`` is a test."""
    return SCHEMAS.get(mode, SCHEMAS["test"])


def use_schema(spark: SparkSession, root: str, mode: str = "test") -> str:
    """The schema of a mode, made below ``root`` if it is not there."""
    name = schema_name(mode)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}` LOCATION '{root.rstrip('/')}/{name}'")
    return name


def bucket_count(pages: DataFrame, body: str = "html") -> int:
    """Buckets of about ``BUCKET_BYTES``, at least as many as cores."""
    size = pages.agg(F.sum(F.octet_length(body))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, math.ceil(size / BUCKET_BYTES))


def save_store(pages: DataFrame, name: str, path: str, buckets: int | None = None, key: str = "url") -> DataFrame:
    """Write ``pages`` as the table ``name`` in buckets of ``key``, and read it.

    The one shuffle of the bodies; it deals them out as the buckets do, so that every
    bucket is one file.
    """
    n = buckets or bucket_count(pages)
    spread = pages.repartition(n, key)
    spread.write.bucketBy(n, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(name)
    return pages.sparkSession.table(name)


def catalog_table(rows: DataFrame, mode: str, table: str, by: tuple[str, ...] = (), write: str = "append") -> str:
    """Write rows to a table of the production or test schema, partitioned by ``by``; returns its full name."""
    name = f"`{schema_name(mode)}`.`{table}`"
    spread = rows.hint("rebalance", *[F.col(c) for c in by]) if by else rows
    spread.write.mode(write).partitionBy(*by).saveAsTable(name)
    return name
