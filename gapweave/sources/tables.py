"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


# Tables whose rows carry long texts, so that work per row outweighs a shuffle.
TEXT_TABLES = ("pages", "documents")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# A table of fewer splits is small enough to be shuffled whole.
FEW_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table of a few splits.

    A small table is often one row group and would be worked on by one task.
    However many cores there are, larger tables are left alone; their splits are
    set by ``spark.sql.files.maxPartitionBytes``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def entities_from_names(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Bare names as entity rows without context and purpose."""
    return df.select(
        F.col(id_col).alias("entity_id"),
        F.col(name_col).alias("name"),
        F.lit(None).cast("string").alias("identifier_context"),
        F.lit(None).cast("string").alias("impute_task_purpose"),
    )


def valid_entities(entities: DataFrame, strict: bool = False) -> DataFrame:
    """Drop entities with a blank name; ``strict`` fails the job instead."""
    blank = F.coalesce(urls.strip("name") == "", F.lit(True))
    if strict:
        checked = F.when(blank, F.raise_error(F.lit("entity name cannot be empty"))).otherwise(F.col("name"))
        return entities.withColumn("name", checked)
    return entities.filter(~blank)


def schema_field_rows(df: DataFrame, fields: str = "fields") -> DataFrame:
    """``array<struct<name,desc,example,…>>`` as one row per usable field."""
    rows = df.select(
        *[c for c in df.columns if c != fields],
        F.posexplode(fields).alias("pos", "field"),
    ).select("*", "field.*").drop("field")
    usable = (urls.strip(F.col("name")) != "") & (urls.strip(F.col("desc")) != "")
    return rows.filter(usable)


def convert_fields(fields):
    """Keep name, description and example of every wanted field."""
    return F.transform(
        fields,
        lambda f: F.struct(f["name"].alias("name"), f["desc"].alias("desc"), f["example"].alias("example")),
    )


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files, one row each, with the file name as link."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
