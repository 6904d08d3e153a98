"""Session settings and scratch space.

Everything that outlives one stage (streaming checkpoints, written hand-over
tables) goes to the shared folder named by ``spark.checkpoint.dir``.  Only a
session whose driver and executors are one process (master ``local`` or
``local[n]``) may do without that setting; it then gets a folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results or skew handling depend on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gapweave")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    A cluster must name a shared folder.  A single process, as in tests, gets a
    folder on this machine, which is then remembered for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gapweave.local.scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="gapweave-")
        spark.conf.set("gapweave.local.scratch", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def hand_over(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Used where two consumers must see one and the same materialised result:
    lost executors then re-read files instead of recomputing the lineage.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
