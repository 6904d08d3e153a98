"""The run log: a row per run and rows per link, partitioned by day.

A run's links stay rows of their own tables instead of one nested value, so a
run may have any number of them.  Page bodies are not logged, only sizes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import store
from . import fetch

RUNS, HITS, SCRAPES, EXTRACTS, VALUES, ERRORS = TABLES = ("runs", "hits", "scrapes", "extracts", "values", "errors")
COSTS = ("serp_cost", "scrape_cost", "extraction_cost", "cost_per_successful_extraction", "total_cost")
BATCH, COMMITS = "log_batch", "commits"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def save_pages(scrapes: DataFrame, path: str, overwrite: bool = False) -> None:
    """Store ready, non-empty pages by kind; refuses to overwrite unless asked."""
    kept = scrapes.filter(F.col("success") & fetch.is_extractable())
    kept.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("data_kind").parquet(path)


def log_path(root: str, mode: str = "test", table: str = "run_log") -> str:
    """Production and test logs live apart; anything but ``prod`` is a test."""
    return f"{root.rstrip('/')}/{store.schema_name(mode)}/{table}"


def run_records(runs: DataFrame, fields) -> DataFrame:
    """Flat run metrics nested by purpose, with the wanted fields' names and descriptions."""
    schema = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(f.desc).alias("desc")) for f in fields]
    )
    c = F.col
    return runs.select(
        "run_id",
        "query",
        schema.alias("schema"),
        "success",
        "status",
        F.struct("urls_found", "urls_scraped", "urls_extracted", "urls_failed").alias("status_details"),
        F.struct(
            "urls_found", "successful_scrapes", "successful_extractions",
            "scrape_success_rate", "extraction_success_rate", "overall_success_rate",
        ).alias("performance"),
        F.struct(*COSTS).alias("costs"),
        c("urls_failed").alias("errors"),
        "created_at",
        "completed_at",
        F.to_date("created_at").alias("run_date"),
    )


def write_log(tables: dict[str, DataFrame], path: str, batch: str | None = None) -> str:
    """Add the tables of some runs; each has ``run_id`` and ``run_date``.  Returns the batch.

    A batch has a folder in every table and is committed by a last small file, which
    also keeps the tables' columns, since a table without rows leaves no file.  So a
    write that broke off shows nothing, and one that is tried again under the same
    ``batch`` replaces what it had written.  The rebalance before each write merges
    small days and splits large ones, so neither tiny files nor one oversized task
    come out of a skewed day.
    """
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown log tables {sorted(unknown)}")
    batch = batch or uuid.uuid4().hex
    for name, rows in tables.items():
        folder = f"{path}/{name}/{BATCH}=b-{batch}"
        rows.hint("rebalance", F.col("run_date")).write.mode("overwrite").partitionBy("run_date").parquet(folder)
    if tables:
        spark = next(iter(tables.values())).sparkSession
        columns = json.dumps({name: json.loads(rows.schema.json()) for name, rows in tables.items()})
        spark.range(1).select(F.current_timestamp().alias("committed_at"), F.lit(columns).alias("columns")).write.mode("overwrite").parquet(
            f"{path}/{COMMITS}/{BATCH}=b-{batch}"
        )
    return batch


def read_log(
    spark: SparkSession, path: str, run_id: int | None = None, names: tuple[str, ...] = (RUNS, SCRAPES, EXTRACTS)
) -> dict[str, DataFrame]:
    """The named tables of committed batches, for one run or for all; a missing id gives no rows."""
    commits = spark.read.option("mergeSchema", True).parquet(f"{path}/{COMMITS}")
    done, columns = commits.select(BATCH), {}
    if "columns" in commits.columns:
        # the last batch with a table has the columns that are read
        known = commits.select("committed_at", F.explode(F.from_json("columns", "map<string, string>")).alias("name", "schema"))
        last = known.groupBy("name").agg(F.max_by("schema", "committed_at").alias("schema")).collect()  # a row per table
        columns = {r.name: T.StructType.fromJson(json.loads(r.schema)).add(BATCH, "string") for r in last}
    tables = {}
    for name in names:
        rows = (spark.read.schema(columns[name]) if name in columns else spark.read).parquet(f"{path}/{name}")
        rows = rows if run_id is None else rows.filter(F.col("run_id") == run_id)
        tables[name] = rows.join(done, BATCH, "left_semi").drop(BATCH)
    return tables


def write_log_tables(tables: dict[str, DataFrame], root: str, mode: str = "test", prefix: str = "") -> dict[str, str]:
    """The log as tables of the production or test schema, made below ``root``; the full name of each."""
    for rows in tables.values():
        store.use_schema(rows.sparkSession, root, mode)
    return {name: store.catalog_table(rows, mode, prefix + name, ("run_date",)) for name, rows in tables.items()}


def export_runs(runs: DataFrame) -> DataFrame:
    """Each run as one JSON text with ISO timestamps."""
    columns = (
        "run_id query schema status success created_at completed_at status_details performance costs errors"
    ).split()
    record = F.to_json(F.struct(*columns), {"timestampFormat": ISO, "timestampNTZFormat": ISO})
    return runs.select("run_id", record.alias("record"))


def export_links(scrapes: DataFrame, extracts: DataFrame) -> DataFrame:
    """The links of the runs, each as one JSON text."""

    def lines(rows, kind):
        columns = [c for c in rows.columns if c not in ("run_id", "run_date")]
        return rows.select("run_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*columns)).alias("record"))

    return lines(scrapes, "scrape").unionByName(lines(extracts, "extract"))
