"""How texts are handed to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import prepare

# Documents differ in length by orders of magnitude, so batches are bounded by both.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def prepare_texts(spark: SparkSession) -> SparkSession:
    """The session's settings, with Arrow batches small enough that a worker holds few texts at once."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark
