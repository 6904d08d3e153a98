"""Costs, rates, counters and rankings of runs.

All are grouped aggregates with partial aggregation before the shuffle; ties
are broken by link so that results do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FAILED, FINISHED
from ..functions.usage import cost_per, exact_sum, money, rate, status_text
from . import running

PLACES = 6


def _money(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), PLACES)


def _seconds(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


# --- search and scrape costs ------------------------------------------------------


def channel_statistics(hits: DataFrame, channel_usage: DataFrame) -> DataFrame:
    """Hits, cost, time and best hit per channel, and a total row."""
    best = F.min_by("title", F.struct("channel_rank", "link"))
    per_hit = hits.groupBy("channel").agg(F.count("*").alias("results"), best.alias("top_result"))
    per_use = channel_usage.groupBy("channel").agg(exact_sum(F.col("cost")).alias("cost"), F.sum("elapsed").alias("elapsed"))
    # a channel without a usage row still counts with its hits, one without hits with its cost
    hit = per_hit.withColumnRenamed("channel", "_channel")
    merged = per_use.join(hit, F.col("channel").eqNullSafe(F.col("_channel")), "full_outer").withColumn("channel", F.coalesce("channel", "_channel"))
    by_channel = merged.rollup("channel").agg(
        F.coalesce(F.sum("results"), F.lit(0)).alias("results"),
        F.round(F.sum("cost"), PLACES).alias("cost"),
        F.round(F.sum("elapsed"), PLACES).alias("elapsed"),
        F.count("*").alias("channels"),
        F.when(F.grouping("channel") == 0, F.max("top_result")).alias("top_result"),
        F.grouping("channel").alias("_total"),
    )
    # hits and usage without a channel keep a row of their own
    return by_channel.withColumn("channel", F.when(F.col("_total") == 1, F.lit("(all)")).otherwise(F.col("channel"))).drop("_total")


def scrape_costs(scrapes: DataFrame) -> DataFrame:
    """Totals and averages over all rows with a known cost."""
    cost, paid = F.col("cost"), F.when(F.col("success"), F.col("cost"))
    return scrapes.agg(
        _money(exact_sum(cost)).alias("total_cost"),
        _money(exact_sum(paid)).alias("successful_scrapes_cost"),
        cost_per(exact_sum(cost), F.count(cost)).alias("avg_cost_per_scrape"),
        cost_per(exact_sum(paid), F.count(paid)).alias("avg_cost_per_successful"),
    )


def scrape_cost_text(costs: DataFrame) -> DataFrame:
    """The total in one line."""
    total = F.col("total_cost").cast("decimal(18,4)").cast("string")
    return costs.withColumn("summary", F.concat(F.lit("Scraping cost: $"), total))


def scrape_cost_analysis(scrapes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, rates and extremes; unknown costs count as 0."""
    cost = F.coalesce("cost", F.lit(0.0))
    ready = F.col("status") == "ready"
    chars = F.sum(F.when(ready, F.length("data")))
    n_ready = F.count_if(ready)
    grouped = scrapes.groupBy(*by).agg(
        exact_sum(cost).alias("_cost"),
        n_ready.alias("successful_scrapes"),
        F.count_if(~ready).alias("failed_scrapes"),
        F.count("*").alias("total_urls"),
        F.coalesce(chars, F.lit(0)).alias("total_characters"),
        # dearest and cheapest link; of equal ones the smallest link
        F.min_by("url", F.struct(-cost, F.col("url"))).alias("most_expensive_url"),
        F.min_by("url", F.struct(cost, F.col("url"))).alias("cheapest_url"),
    )
    return grouped.select(
        *by,
        F.round("_cost", PLACES).alias("total_cost"),
        "successful_scrapes",
        "failed_scrapes",
        "total_urls",
        F.round(rate(F.col("successful_scrapes"), F.col("total_urls")), PLACES).alias("success_rate"),
        cost_per(F.col("_cost"), F.col("total_urls")).alias("avg_cost_per_url"),
        cost_per(F.col("_cost"), F.col("successful_scrapes")).alias("avg_cost_per_success"),
        "total_characters",
        F.round(rate(F.col("total_characters"), F.col("successful_scrapes")), PLACES).alias("avg_chars_per_success"),
        "most_expensive_url",
        "cheapest_url",
    )


def costs_by_url(scrapes: DataFrame) -> DataFrame:
    """The per-link costs that go with the analysis, as rows."""
    return scrapes.select("entity_id", "url", F.coalesce("cost", F.lit(0.0)).alias("cost"))


# --- runs -----------------------------------------------------------------------


def stage_counters(events: DataFrame) -> DataFrame:
    """Progress counters of each run; what is under way is never below 0."""

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
        exact_sum(F.col("cost")).alias("total_cost"),
        _seconds(F.max("ts"), F.min("ts")).alias("seconds"),
    )


def with_status_text(runs: DataFrame) -> DataFrame:
    c = F.col
    text = status_text(
        c("status"), c("serp_completed"), c("urls_scraping"), c("urls_extracting"),
        c("urls_extracted"), c("urls_failed"), c("urls_found"), c("urls_failed"),
    )
    return runs.withColumn("status_text", text)


def run_metrics(events: DataFrame) -> DataFrame:
    """Success rates, cost of each stage and cost per success of each run."""

    def n(stage):
        return F.count_if(F.col("stage") == stage)

    def spent(stage):
        return F.coalesce(exact_sum(F.when(F.col("stage") == stage, F.col("cost"))), F.lit(0.0))

    base = events.groupBy("run_id").agg(
        n("found").alias("urls_found"),
        n("scraped").alias("successful_scrapes"),
        n("extracted").alias("successful_extractions"),
        n("failed").alias("urls_failed"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("completed_at"),
        spent("found").alias("serp"),
        spent("scraped").alias("scrape"),
        spent("extracted").alias("extraction"),
    )
    total = F.col("serp") + F.col("scrape") + F.col("extraction")
    return base.select(
        "run_id",
        "urls_found",
        "successful_scrapes",
        "successful_extractions",
        "urls_failed",
        "created_at",
        "completed_at",
        F.round(rate(F.col("successful_scrapes"), F.col("urls_found")), PLACES).alias("scrape_success_rate"),
        F.round(rate(F.col("successful_extractions"), F.col("successful_scrapes")), PLACES).alias("extraction_success_rate"),
        F.round(rate(F.col("successful_extractions"), F.col("urls_found")), PLACES).alias("overall_success_rate"),
        F.round("serp", PLACES).alias("serp_cost"),
        F.round("scrape", PLACES).alias("scrape_cost"),
        F.round("extraction", PLACES).alias("extraction_cost"),
        F.round(total, PLACES).alias("total_cost"),
        cost_per(total, F.col("successful_extractions")).alias("cost_per_successful_extraction"),
    )


def cost_extremes(events: DataFrame, threshold: float) -> DataFrame:
    """Dearest link, cheapest success and whether a run passed its limit."""
    extracted = F.col("stage") == "extracted"
    total = exact_sum(F.col("cost"))
    return events.groupBy("run_id").agg(
        # an unknown cost is no cost: a null order is passed over
        F.min_by("url", F.when(F.col("cost").isNotNull(), F.struct(-F.col("cost"), F.col("url")))).alias("most_expensive_url"),
        F.min(F.when(extracted, F.col("cost"))).alias("cheapest_successful_extraction"),
        (F.round(total, PLACES) > threshold).alias("cost_threshold_exceeded"),
        cost_per(total, F.count_if(extracted)).alias("cost_per_result"),
    )


def run_outcome(scrapes: DataFrame, extracts: DataFrame, fast_path_only: bool = False) -> DataFrame:
    """FINISHED where any extract succeeded (any page with data, for fast path only)."""
    fetched = scrapes.groupBy("entity_id").agg(
        F.bool_or(F.coalesce(F.col("success") & (F.length("data") > 0), F.lit(False))).alias("any_data")
    )
    got = extracts.groupBy("entity_id").agg(F.bool_or("success").alias("any_extract"))
    both = fetched.join(got, "entity_id", "left")
    success = F.col("any_data") if fast_path_only else F.coalesce("any_extract", F.lit(False))
    return both.select(
        "entity_id",
        success.alias("success"),
        F.when(success, FINISHED).otherwise(FAILED).alias("status"),
    )


def result_counters(scrapes: DataFrame, extracts: DataFrame) -> DataFrame:
    fetched = scrapes.groupBy("entity_id").agg(
        F.count_distinct("url").alias("total_urls_scraped"),
        F.count_if(F.col("status") == "ready").alias("successful_scrapes"),
    )
    got = extracts.groupBy("entity_id").agg(F.count_if("success").alias("successful_extractions"))
    return fetched.join(got, "entity_id", "left").withColumn(
        "successful_extractions", F.coalesce("successful_extractions", F.lit(0).cast("long"))
    )


def error_messages(scrapes: DataFrame, min_chars: int) -> DataFrame:
    """All messages of a run as rows: failures and pages below the gate."""
    from . import fetch

    failed = fetch.failure_reasons(scrapes).select("entity_id", "url", F.col("reason").alias("message"))
    small = fetch.size_gate(fetch.extractable(scrapes), min_chars).filter(~F.col("passed"))
    return failed.unionByName(small.select("entity_id", "url", F.col("gate_error").alias("message")))


def cost_breakdown(events: DataFrame) -> DataFrame:
    """Cost per run and stage with totals per run and over all."""
    return (
        events.rollup("run_id", "stage")
        .agg(F.round(exact_sum(F.col("cost")), PLACES).alias("cost"), F.count("*").alias("n"), F.grouping_id().alias("level"))
        .withColumn("level", F.col("level").cast("long"))
    )


# --- order within a run ---------------------------------------------------------


def running_cost(events: DataFrame, limit: float) -> DataFrame:
    """Cumulative cost in time order and the first event past the budget, in
    decimals so that the border does not depend on the order of sums."""
    cost = F.coalesce(money("cost"), F.lit(0))
    done = running.running_sums(events, ["run_id"], ["ts", "url"], {"_sum": cost})
    border = money(F.lit(limit))
    over = F.col("_sum") > border
    before = F.col("_sum") - cost > border
    return (
        done.withColumn("running_cost", F.round(F.col("_sum").cast("double"), PLACES))
        .withColumn("over_budget", over)
        .withColumn("is_cut", over & ~before)
        .drop("_sum")
    )


def event_gaps(events: DataFrame) -> DataFrame:
    """Seconds since the previous event of the same run."""
    done = running.previous_value(events, ["run_id"], ["ts", "event_id"], "ts", "previous_ts")
    return done.withColumn("gap_seconds", _seconds(F.col("ts"), F.col("previous_ts")))


def cost_rank(scrapes: DataFrame) -> DataFrame:
    """Position of each link by cost, dearest first, with ties sharing it.

    Equal costs are counted first; the distinct ones are then accumulated.
    """
    rows = scrapes.select("entity_id", "url", F.coalesce("cost", F.lit(0.0)).alias("cost"))
    levels = rows.groupBy("entity_id", "cost").agg(F.count("*").alias("n"))
    sums = {"dense_rank": F.lit(1).cast("long"), "upto": F.col("n")}
    ranks = running.running_sums(levels, ["entity_id"], [F.desc("cost")], sums)
    ranks = ranks.select("entity_id", "cost", "dense_rank", (F.col("upto") - F.col("n") + 1).alias("rank"))
    return rows.join(ranks, ["entity_id", "cost"])


def first_results(extracts: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` results of each run and how many more there are."""
    first = Window.partitionBy("entity_id").orderBy("url")
    top = extracts.withColumn("pos", F.row_number().over(first)).filter(F.col("pos") <= k)
    counts = extracts.groupBy("entity_id").agg(F.count("*").alias("_n"))
    return top.join(counts, "entity_id").withColumn("more", F.greatest(F.lit(0), F.col("_n") - k)).drop("_n")
