"""Durations of fetching and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 6

# Phases as (name, from, to) …
SCRAPE_PHASES = (
    ("request_to_snapshot", "request_sent", "snapshot_received"),
    ("snapshot_to_poll", "snapshot_received", "snapshot_polled"),
    ("poll_to_data", "snapshot_polled", "data_received"),
    ("total_scrape_time", "request_sent", "data_received"),
)
EXTRACT_PHASES = (
    ("filter_request_to_enqueue", "filter_requested", "filter_enqueued"),
    ("filter_enqueue_to_dequeue", "filter_enqueued", "filter_dequeued"),
    ("filter_dequeue_to_complete", "filter_dequeued", "filter_completed"),
    ("parse_request_to_enqueue", "parse_requested", "parse_enqueued"),
    ("parse_enqueue_to_dequeue", "parse_enqueued", "parse_dequeued"),
    ("parse_dequeue_to_convertstart", "parse_dequeued", "convert_start"),
    ("parse_converttodict_duration", "convert_start", "convert_end"),
    ("parse_convertend_to_complete", "convert_end", "parse_completed"),
    ("filter_total_time", "filter_requested", "filter_completed"),
    ("parse_total_time", "parse_requested", "parse_completed"),
    ("filter_to_parse_gap", "filter_requested", "parse_requested"),
)
# … and limits in seconds as (phase, limit, limit of high concern, advice)
SCRAPE_ADVICE = "Pages come in slowly: raise the number of parallel fetches or shorten their timeout"
QUEUE_ADVICE = "Calls wait in the queue: allow the model service more calls at once"
CONVERT_ADVICE = "Converting answers takes long: move it off the thread that waits for them"
LIMITS = (
    ("request_to_snapshot", 10.0, 30.0, SCRAPE_ADVICE),
    ("snapshot_to_poll", 10.0, 30.0, SCRAPE_ADVICE),
    ("poll_to_data", 10.0, 30.0, SCRAPE_ADVICE),
    ("total_scrape_time", 10.0, 30.0, SCRAPE_ADVICE),
    ("parse_converttodict_duration", 0.1, 0.5, CONVERT_ADVICE),
    ("filter_enqueue_to_dequeue", 1.0, 5.0, QUEUE_ADVICE),
    ("parse_enqueue_to_dequeue", 1.0, 5.0, QUEUE_ADVICE),
    ("filter_to_parse_gap", 0.1, 0.5, None),
)


def seconds_between(start: str, end: str) -> Column:
    """Seconds from one instant column to another, null if either is missing."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def average_seconds(start: str, end: str) -> Column:
    """Average in whole microseconds, so that it does not depend on the order of rows."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.round(F.try_divide(F.sum(micros), F.count(micros))) / F.lit(1_000_000.0)


def parse_instant(text: Column) -> Column:
    """ISO-8601 text, with ``Z`` or an offset, as timestamp; null if it is none.

    Of a JSON list of instants the last one counts.
    """
    many = F.try_element_at(F.from_json(text, "array<string>"), F.lit(-1))
    return F.try_to_timestamp(F.when(text.startswith("["), many).otherwise(text))


def phase_rows(times: DataFrame) -> DataFrame:
    """One row per link and phase that has both instants; one pass over the input."""
    phases = F.array(
        *[
            F.struct(F.lit(name).alias("phase"), seconds_between(a, b).alias("seconds"))
            for name, a, b in SCRAPE_PHASES + EXTRACT_PHASES
        ]
    )
    return times.select("run_id", "url", F.inline(phases)).filter(F.col("seconds").isNotNull())


def phase_statistics(times: DataFrame) -> DataFrame:
    """Least, greatest, average and sample deviation of each phase."""
    micros = F.round(F.col("seconds") * 1_000_000).cast("long")
    return phase_rows(times).groupBy("phase").agg(
        F.count("*").alias("n"),
        F.round(F.min("seconds"), PLACES).alias("min"),
        F.round(F.max("seconds"), PLACES).alias("max"),
        (F.round(F.sum(micros) / F.count("*")) / F.lit(1_000_000.0)).alias("avg"),
        F.round(F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)), PLACES).alias("std"),
    )


def judged_phases(statistics: DataFrame) -> DataFrame:
    """Each phase with its limit, how bad it is and what to do; nulls where all is well."""
    limits = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"),
                F.lit(limit).alias("threshold"),
                F.lit(high).alias("high"),
                F.lit(advice).cast("string").alias("recommendation"),
            )
            for p, limit, high, advice in LIMITS
        ]
    )
    found = F.get(F.filter(limits, lambda x: x["p"] == F.col("phase")), F.lit(0))
    rows = statistics.withColumn("limit", found)
    slow = F.col("max") > F.col("limit.threshold")
    level = F.when(F.col("max") > F.col("limit.high"), "high").otherwise("medium")
    return (
        rows.withColumn("threshold", F.when(slow, F.col("limit.threshold")))
        .withColumn("concern_level", F.when(slow, level))
        .withColumn("recommendation", F.when(slow, F.col("limit.recommendation")))
        .drop("limit")
    )


def slow_phases(statistics: DataFrame) -> DataFrame:
    """Only the phases past their limit."""
    slow = judged_phases(statistics).filter(F.col("concern_level").isNotNull())
    return slow.select(
        "phase",
        F.col("max").alias("max_duration"),
        F.col("avg").alias("avg_duration"),
        "threshold",
        "concern_level",
        "recommendation",
    )


def url_delays(scrapes: DataFrame, extracts: DataFrame) -> DataFrame:
    """Delay and processing time of links that were both fetched and extracted."""
    both = scrapes.join(extracts, ["run_id", "url"])
    return both.select(
        "run_id",
        "url",
        seconds_between("scrape_end", "extract_start").alias("delay"),
        seconds_between("scrape_start", "extract_end").alias("processing_time"),
    )


def streaming_metrics(stages: DataFrame) -> DataFrame:
    """Rates and per-link times of each run; divisors are at least 1."""
    one = F.lit(1).cast("long")
    took = seconds_between("scrape_start", "extract_end")
    attempted, scraped, extracted = F.count("scrape_start"), F.count("scrape_end"), F.count("extract_end")
    started = F.count("extract_start")
    return stages.groupBy("run_id").agg(
        F.round(scraped / F.greatest(attempted, one), PLACES).alias("scrape_success_rate"),
        F.round(extracted / F.greatest(started, one), PLACES).alias("extract_success_rate"),
        F.round(extracted / F.greatest(F.count("*"), one), PLACES).alias("overall_success_rate"),
        average_seconds("scrape_start", "extract_end").alias("avg_url_processing_time"),
        F.round(F.min(took), PLACES).alias("fastest_url_time"),
        F.round(F.max(took), PLACES).alias("slowest_url_time"),
    )


def stage_time_statistics(stages: DataFrame) -> DataFrame:
    """Average, least, greatest and deviation of fetch and extraction times."""

    def four(name):
        start, end = f"{name}_start", f"{name}_end"
        s = seconds_between(start, end)
        return [
            average_seconds(start, end).alias(f"avg_{name}_time"),
            F.round(F.min(s), PLACES).alias(f"min_{name}_time"),
            F.round(F.max(s), PLACES).alias(f"max_{name}_time"),
            F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), PLACES).alias(f"std_{name}_time"),
        ]

    return stages.groupBy("run_id").agg(*four("scrape"), *four("extract"))


def overlap(stages: DataFrame) -> DataFrame:
    """Did extraction start before the last fetch had ended, and what it saved."""
    runs = stages.groupBy("run_id").agg(
        F.max("scrape_end").alias("last_scrape"),
        F.min("extract_start").alias("first_extract"),
        average_seconds("scrape_end", "extract_start").alias("avg_delay"),
    )
    saved = seconds_between("first_extract", "last_scrape")
    return runs.filter(F.col("last_scrape").isNotNull() & F.col("first_extract").isNotNull()).select(
        "run_id",
        (F.col("first_extract") < F.col("last_scrape")).alias("streaming_extraction"),
        F.round(saved, PLACES).alias("time_saved"),
        F.coalesce("avg_delay", F.lit(0.0)).alias("avg_delay"),
    )


def time_to_first_result(stages: DataFrame) -> DataFrame:
    runs = stages.groupBy("run_id").agg(
        F.min("scrape_start").alias("started"), F.min("extract_end").alias("first_result")
    )
    return runs.select("run_id", F.round(seconds_between("started", "first_result"), PLACES).alias("time_to_first_result"))
