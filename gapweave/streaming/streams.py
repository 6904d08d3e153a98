"""The same operators on arriving rows.

Every stream takes a checkpoint folder below the cluster's shared one and writes
either with the exactly-once file sink or batch by batch into a folder named by
the batch id, so that a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import FAILED, FINISHED, INITIALIZING, RUNNING, Field, RunConfig
from ..functions.usage import exact_sum
from ..operators import extract, fetch
from ..session import scratch_dir


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive.

    The path is given as a pattern that only matches itself, because a stream
    takes a plain path for a folder while a table may be one file.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def run_to_end(query) -> None:
    """Wait for an ``availableNow`` query and pass on its failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def append_files(stream: DataFrame, path: str) -> None:
    """Drain an append stream into Parquet files."""
    run_to_end(
        stream.writeStream.format("parquet")
        .option("checkpointLocation", scratch_dir(stream.sparkSession))
        .trigger(availableNow=True)
        .start(path)
    )


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Drain a stream through ``write(rows, batch_id)``."""
    run_to_end(
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", scratch_dir(stream.sparkSession))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch into its own folder; a batch that is run again overwrites itself."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def state_writer(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """The state of all keys after each batch, in two folders in turn.

    A batch is merged with what the one before it has left, so reading the state
    takes two copies at most, however long the stream runs; a batch that is run
    again overwrites itself.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        if batch_id:
            before = rows.sparkSession.read.parquet(f"{path}/slot={(batch_id - 1) % 2}").drop("batch")
            rows = fetch.update_rows(before, rows, keys)
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state written for each key by an update stream."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch", "slot")]
    last = F.max_by(F.struct(*rest), F.col("batch"))
    return rows.groupBy(*keys).agg(last.alias("s")).select(*keys, "s.*")


# --- extraction -----------------------------------------------------------------------


def extract_stream(scrapes: DataFrame, fields: list[Field], config: RunConfig) -> DataFrame:
    """Gate and extract each page as it arrives: the batch functions, unchanged."""
    gated = fetch.size_gate(fetch.extractable(scrapes), config.min_page_chars).filter("passed")
    return extract.extract(gated, fields, config)


# --- counters and metrics ------------------------------------------------------------------


def with_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need an instant, not a local time; the session zone is UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def live_counters(events: DataFrame) -> DataFrame:
    """Progress counters of each run, updated with every batch."""

    def n(stage):
        return F.count_if(F.col("stage") == stage)

    zero = F.lit(0).cast("long")
    return events.groupBy("run_id").agg(
        F.greatest(zero, n("scraping") - n("scraped")).alias("urls_scraping"),
        n("scraped").alias("urls_scraped"),
        F.greatest(zero, n("extracting") - n("extracted")).alias("urls_extracting"),
        n("extracted").alias("urls_extracted"),
        n("failed").alias("urls_failed"),
        n("found").alias("urls_found"),
    )


def windowed_metrics(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Cost, events and success rate per time window; later rows are dropped."""
    timed = with_event_time(events).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    done = F.count_if(F.col("stage").isin("extracted", "failed"))
    return timed.groupBy(window.alias("w")).agg(
        F.count("*").alias("n_events"),
        F.round(exact_sum(F.col("cost")), 6).alias("cost"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("stage") == "extracted"), done), F.lit(0.0)), 6).alias("success_rate"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "cost", "success_rate")


REQUEST_STATE = "last long, times array<long>, ids array<long>"
REQUEST = "query string, top_k long, ts timestamp, id long"
REQUEST_COLUMNS = ["query", "top_k", "ts", "id"]


def first_requests(requests: DataFrame, unique: str, lifetime_ms: int = 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """Requests with no request of the same key let through in the lifetime before them.

    In the order of event time, ties by ``unique``: a request waits until the
    watermark has passed it, so the answer does not depend on how the stream is cut
    into batches.  What the watermark has not reached yet is still to come.
    """

    def step(key, chunks, state):
        last, times, ids = state.get if state.exists else (-1, [], [])
        waiting = list(zip(times, ids))
        if not state.hasTimedOut:
            for chunk in chunks:
                waiting += zip(chunk["micros"].tolist(), chunk["id"].tolist())
        waiting.sort()
        mark = state.getCurrentWatermarkMs()
        out, n = [], 0
        for micros, unique_id in waiting:
            if micros > mark * 1000:
                break
            n += 1
            if last < 0 or micros - last > lifetime_ms * 1000:
                out.append((key[0], key[1], pd.Timestamp(micros, unit="us", tz="UTC"), unique_id))
                last = micros
        waiting = waiting[n:]
        # wake up when the next one is due, or when the last one is forgotten
        due = waiting[0][0] // 1000 if waiting else last // 1000 + lifetime_ms
        if waiting or due > mark:
            state.update((last, [w[0] for w in waiting], [w[1] for w in waiting]))
            state.setTimeoutTimestamp(max(due, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=REQUEST_COLUMNS)

    timed = with_event_time(requests).withWatermark("ts", late)
    rows = timed.select(
        "query", F.col("top_k").cast("long").alias("top_k"), F.col(unique).alias("id"), "ts", F.unix_micros("ts").alias("micros")
    )
    return rows.groupBy("query", "top_k").applyInPandasWithState(
        step, REQUEST, REQUEST_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


# --- run lifecycle ------------------------------------------------------------------------


def run_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of activity of each run, merged with partial aggregation, and how they ended."""
    timed = with_event_time(events).withWatermark("ts", late)
    ok = F.count_if(F.col("stage") == "extracted") > 0
    return (
        timed.groupBy("run_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n_events"), F.when(ok, FINISHED).otherwise(FAILED).alias("status"))
        .select("run_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "status")
    )


STATE = "status string, n_events long, extracted long, last_micros long"
TRANSITION = "run_id long, status string, n_events long, extracted long"
TRANSITION_COLUMNS = ["run_id", "status", "n_events", "extracted"]


def lifecycle(events: DataFrame, timeout_ms: int = 30 * 60 * 1000, late: str = "1 hour") -> DataFrame:
    """Each run's state as it changes: initializing, running, finished, failed.

    A run finishes with its first extracted value and fails when nothing has
    been heard of it for ``timeout_ms`` of event time.
    """

    def step(key, chunks, state):
        status, n, extracted, last = state.get if state.exists else (INITIALIZING, 0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            if status != FINISHED:
                yield pd.DataFrame([(key[0], FAILED, n, extracted)], columns=TRANSITION_COLUMNS)
            return
        for chunk in chunks:
            n += len(chunk)
            extracted += int(chunk["extracted"].sum())
            last = max(last, int(chunk["micros"].max()))
        now = FINISHED if extracted else RUNNING
        state.update((now, n, extracted, last))
        due = last // 1000 + timeout_ms
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame([(key[0], now, n, extracted)], columns=TRANSITION_COLUMNS)

    # every event comes with its own time, so that lateness does not depend on how rows are batched
    timed = with_event_time(events).withWatermark("ts", late)
    return (
        timed.select("run_id", (F.col("stage") == "extracted").cast("long").alias("extracted"), "ts", F.unix_micros("ts").alias("micros"))
        .groupBy("run_id")
        .applyInPandasWithState(step, TRANSITION, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    )
