"""Whole jobs put together from the operators.

Results that several later steps read are written to the shared scratch folder
once (``hand_over``), so no search or extraction runs twice and a lost executor
costs a re-read, not a recomputation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FAILED, FINISHED, MODE_DISABLED, MODE_ONLY, RUNNING, Field, RunConfig
from ..functions import content, urls
from ..functions.usage import cost_per, exact_sum, extract_cost, rate
from ..operators import extract, fetch, gather, link_filter, log, metrics, search, timing
from ..session import hand_over, scratch_dir
from ..sources import tables
from ..streaming import streams

# The error texts of a run.
NO_RESULTS = "SERP failed: No results found"
NO_SCRAPES = "No successful scrapes"
NO_EXTRACTS = "No successful extractions"
FAST_NO_RESULTS = "Fast path failed: No results returned"


@dataclass
class Run:
    """What one run leaves behind: links, page results, fused values, a row and the costs per entity."""

    links: DataFrame
    results: DataFrame
    values: DataFrame
    runs: DataFrame
    costs: DataFrame


# --- search, fetch, extract, gather -----------------------------------------------------


def queries_of(entities: DataFrame) -> DataFrame:
    query = urls.build_query(F.col("name"), F.col("identifier_context"), F.col("impute_task_purpose"))
    return tables.valid_entities(entities).select("entity_id", query.alias("name"))


def page_results(pages: DataFrame, fields: list[Field], config: RunConfig, keep: list[str] = ()) -> DataFrame:
    """Gate and extract each page once, whoever asked for it; bodies end here."""
    rows = fetch.size_gate(pages.select("url", F.col("html").alias("data"), *keep), config.min_page_chars)
    rows = rows.withColumn("data", F.when(F.col("passed"), F.col("data")))
    done = extract.with_content(rows, fields, config)
    return done.select("url", "n_chars", "passed", "gate_error", *keep, *extract.EXTRACT_COLUMNS)


def link_results(links: DataFrame, per_page: DataFrame) -> DataFrame:
    """Each requested link with the result of its page; missing pages are failed rows."""
    joined = links.join(per_page.withColumn("fetched", F.lit(True)), "url", "left")
    fetched = F.coalesce("fetched", F.lit(False))
    return (
        joined.withColumn("fetched", fetched)
        .withColumn("status", F.when(fetched, "ready").otherwise("failed"))
        .withColumn("success", F.coalesce("success", F.lit(False)))
        .withColumn(
            "error", F.when(~fetched, F.lit(fetch.NO_PAGE)).otherwise(F.coalesce("gate_error", "error"))
        )
    )


def fused_values(results: DataFrame, config: RunConfig) -> DataFrame:
    values = extract.value_rows(results)
    kept = gather.confident_values(values, config.confidence, config.relaxed_confidence, config.min_extractions)
    return gather.fuse(kept)


def run_rows(entities: DataFrame, results: DataFrame) -> DataFrame:
    """One row per entity, also for those that failed early, with error and counters."""
    per = results.groupBy("entity_id").agg(
        F.count("*").alias("urls_found"),
        F.count_if("fetched").alias("urls_scraped"),
        F.count_if(F.col("fetched") & ~F.col("passed")).alias("urls_too_small"),
        F.count_if("success").alias("urls_extracted"),
    )
    counters = ("urls_found", "urls_scraped", "urls_too_small", "urls_extracted")
    zero = F.lit(0).cast("long")
    rows = entities.select("entity_id").join(per, "entity_id", "left")
    rows = rows.select("entity_id", *[F.coalesce(c, zero).alias(c) for c in counters])
    ok = F.col("urls_extracted") > 0
    error = (
        F.when(F.col("urls_found") == 0, F.lit(NO_RESULTS))
        .when(F.col("urls_scraped") == 0, F.lit(NO_SCRAPES))
        .when(~ok, F.lit(NO_EXTRACTS))
    )
    return rows.withColumn("status", F.when(ok, FINISHED).otherwise(FAILED)).withColumn("error", error)


COSTS = ("serp_cost", "scrape_cost", "extraction_cost")


def run_costs(runs: DataFrame, search_usage: DataFrame | None, fetched: DataFrame, model_usage: DataFrame | None) -> DataFrame:
    """Search, fetch and extraction cost of each entity, their sum, and the cost of a success.

    ``search_usage(entity_id, cost)``, ``fetched(entity_id, url, cost)`` and
    ``model_usage(entity_id, usage)`` are what the outside services reported; an
    unknown cost counts as 0.
    """

    def per_entity(rows: DataFrame | None, cost: str) -> DataFrame | None:
        return rows and rows.groupBy("entity_id").agg(exact_sum(F.coalesce("cost", F.lit(0.0))).alias(cost))

    model = model_usage and model_usage.select("entity_id", extract_cost(F.col("usage")).alias("cost"))
    out = runs.select("entity_id", "urls_extracted")
    for rows, cost in zip((search_usage, fetched, model), COSTS):
        part = per_entity(rows, cost)
        out = out.join(part, "entity_id", "left") if part else out.withColumn(cost, F.lit(0.0))
    out = out.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in COSTS})
    total = F.round(sum((F.col(c) for c in COSTS[1:]), F.col(COSTS[0])), 6)
    return out.withColumn("total_cost", total).select(
        "entity_id", *COSTS, "total_cost", cost_per(F.col("total_cost"), F.col("urls_extracted")).alias("cost_per_successful_extraction")
    )


def vendor_requests(entities: DataFrame, config: RunConfig) -> DataFrame:
    """The vendors' links of each entity, dealt out by entity: a table of short rows may be one split, but meets many answers."""
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    requests = fetch.fast_path_requests(tables.valid_entities(entities), config.fast_path.domains)
    return requests.select("entity_id", "url").repartition(n, "entity_id")


def fast_results(entities: DataFrame, answers: DataFrame, fields: list[Field], config: RunConfig) -> DataFrame:
    """Vendor answers as result rows: JSON by its keys, pages by the usual extraction."""
    requests = vendor_requests(entities, config)
    costs = answers if "cost" in answers.columns else answers.withColumn("cost", F.lit(0.0))
    # an answer is read once, however many entities asked for it; its body ends there
    got = costs.select("url", "success", "data", "data_kind", "cost", "error").join(requests.select("url").distinct(), "url", "left_semi")
    reason = fetch.failure_reason().alias("_reason")
    fits = content.fast_path_usable(F.col("success"), F.col("data"), F.col("data_kind"), config.fast_path.min_result_size)
    rows = got.select("url", "data", "data_kind", "cost", F.col("success").alias("fetched"), fits.alias("passed"), reason)
    is_page = F.col("data_kind") == "html"
    rows = rows.withColumn("_json", F.when(F.col("passed") & ~is_page, F.col("data")))
    rows = rows.withColumn("n_chars", F.length("data")).withColumn("data", F.when(F.col("passed") & is_page, F.col("data")))
    done = extract.with_content(rows, fields, config)
    merged = F.when(F.col("_json").isNotNull(), extract.vendor_content(F.col("_json"), fields)).otherwise(F.col("content"))
    done = hand_over(done.withColumn("content", merged).drop("data", "_json", "_body", "_cut"))
    done = requests.join(done, "url")
    found = F.exists(F.map_values("content"), lambda v: v.isNotNull())
    fetched = F.coalesce("fetched", F.lit(False))
    return done.select(
        "entity_id", "url", F.lit("fast_path").alias("channel"), F.lit(0).alias("pos"), fetched.alias("fetched"), "passed", "n_chars", "cost",
        F.when(fetched, "ready").otherwise("failed").alias("status"), F.coalesce(found, F.lit(False)).alias("success"),
        F.coalesce("_reason", F.when(~F.coalesce(found, F.lit(False)), F.lit(extract.NOTHING_FOUND))).alias("error"),
        "content", "trimmed_to", "reduced", "strategy", "filtered_chars", "stage_tokens",
    )


def page_answers(pages: DataFrame) -> DataFrame:
    """The page store as vendor answers, for runs that have fetched the vendors' links like any other."""
    cost = F.col("cost") if "cost" in pages.columns else F.lit(0.0)
    return pages.select(
        "url", F.lit(True).alias("success"), F.col("html").alias("data"), F.lit("html").alias("data_kind"), cost.alias("cost"),
        F.lit(None).cast("string").alias("error"),
    )


def with_fast_path(normal: DataFrame, fast: DataFrame) -> DataFrame:
    return normal.unionByName(fast, allowMissingColumns=True)


def fast_only_rows(rows: DataFrame, outcome: DataFrame, results: DataFrame) -> DataFrame:
    """Run rows where only the vendors are asked: finished if anything came back, with the reasons as error."""
    # a vendor answer per domain at most, so a run has a handful of reasons
    reasons = results.filter(F.col("error").isNotNull()).groupBy("entity_id").agg(
        F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("_reasons")
    )
    fast = outcome.select("entity_id", F.col("status").alias("_status"), F.col("error").alias("_error"))
    joined = rows.join(fast, "entity_id", "left").join(reasons, "entity_id", "left")
    # an entity without a name was never asked about
    status = F.coalesce("_status", F.lit(FAILED))
    return joined.withColumn("status", status).withColumn("error", F.coalesce("_error", "_reasons", F.when(F.col("_status").isNull(), F.col("error")))).drop(
        "_status", "_error", "_reasons"
    )


def _impute(
    entities: DataFrame,
    fields: list[Field],
    pages: DataFrame,
    config: RunConfig,
    answers: DataFrame | None,
    search_usage: DataFrame | None,
    model_usage: DataFrame | None,
    extracted: Callable[[DataFrame], DataFrame],
) -> Run:
    """A run whose pages are extracted by ``extracted(links)``, at once or as they arrive."""
    mode = config.fast_path.mode
    fast = outcome = None
    rest = entities
    if mode != MODE_DISABLED:
        given = page_answers(pages) if answers is None else answers
        outcome = hand_over(fast_path(entities, given, config))
        fast = fast_results(entities, given, fields, config)
        rest = entities.join(outcome.filter("goes_on").select("entity_id"), "entity_id", "left_semi")
    if mode == MODE_ONLY:
        results, links = fast, fast.select("entity_id", "url", "channel", "pos")
    else:
        found = search.search_links(queries_of(rest), pages, config.top_k, config.interleave, config.deduplicate)
        links = hand_over(found.select("entity_id", F.col("link").alias("url"), "channel", "pos"))
        results = link_results(links, extracted(links))
        if fast is not None:
            results, links = with_fast_path(results, fast), links.unionByName(fast.select("entity_id", "url", "channel", "pos"))
    runs = run_rows(entities, results)
    if mode == MODE_ONLY:
        runs = fast_only_rows(runs, outcome, results)
    fetched = results.select("entity_id", "url", F.col("cost") if "cost" in results.columns else F.lit(0.0).alias("cost"))
    return Run(links, results, fused_values(results, config), runs, run_costs(runs, search_usage, fetched, model_usage))


def _costs(pages: DataFrame) -> list[str]:
    return ["cost"] if "cost" in pages.columns else []


def impute_batch(
    entities: DataFrame,
    fields: list[Field],
    pages: DataFrame,
    config: RunConfig,
    answers: DataFrame | None = None,
    search_usage: DataFrame | None = None,
    model_usage: DataFrame | None = None,
) -> Run:
    """The whole way from entities to values, for any number of entities.

    With a fast path the vendors' ``answers(url, success, data, data_kind, error, cost?)``
    come first (the page store stands in for missing ones), and only entities that
    they don't serve are searched for.  Pages are extracted once per link and only
    if some entity asked for them; afterwards only short results are joined back.
    """

    def extracted(links: DataFrame) -> DataFrame:
        asked = link_filter.asked_pages(pages, links)
        return hand_over(page_results(asked, fields, config, _costs(pages)))

    return _impute(entities, fields, pages, config, answers, search_usage, model_usage, extracted)


def impute_stream(
    entities: DataFrame,
    fields: list[Field],
    pages: DataFrame,
    arriving: DataFrame,
    config: RunConfig,
    answers: DataFrame | None = None,
    search_usage: DataFrame | None = None,
    model_usage: DataFrame | None = None,
) -> Run:
    """As ``impute_batch``, fast path and costs included, but pages are extracted as they arrive.

    Links are searched in the pages known so far; ``arriving`` is a stream of
    fetched pages.  Its results are appended file by file, and everything behind
    them is the batch code, so a restart goes on where the stream stopped.
    """

    def extracted(links: DataFrame) -> DataFrame:
        asked = arriving.join(links.select("url").distinct(), "url", "left_semi")
        path = scratch_dir(pages.sparkSession)
        done = page_results(asked, fields, config, _costs(arriving))
        streams.append_files(done, path)
        return pages.sparkSession.read.schema(done.schema).parquet(path)

    return _impute(entities, fields, pages, config, answers, search_usage, model_usage, extracted)


def fill_table(target: DataFrame, values: DataFrame, fields: list[str]) -> DataFrame:
    """Write fused values into the missing cells of a table, with their source."""
    return gather.impute(target, values, fields)


# --- fast path ------------------------------------------------------------------------------


def fast_path(entities: DataFrame, answers: DataFrame, config: RunConfig) -> DataFrame:
    """Per entity: what the vendors answered, and whether the normal way goes on."""
    mode = config.fast_path.mode
    valid = tables.valid_entities(entities)
    if mode == MODE_DISABLED:
        return valid.select(
            "entity_id", F.lit(False).alias("usable"), F.lit(0).cast("long").alias("n_results"),
            F.lit(True).alias("goes_on"), F.lit(RUNNING).alias("status"), F.lit(None).cast("string").alias("error"),
        )
    judged = fetch.judged_answers(answers, config.fast_path.min_result_size)
    outcome = fetch.outcome_of(vendor_requests(entities, config).join(judged, "url"))
    rows = valid.select("entity_id").join(outcome, "entity_id", "left")
    usable = F.coalesce("usable", F.lit(False))
    nothing = F.col("n_results").isNull()
    only = F.lit(mode == MODE_ONLY)
    goes_on = ~only & (F.lit(config.fast_path.always_continue) | ~usable)
    return rows.select(
        "entity_id",
        usable.alias("usable"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        goes_on.alias("goes_on"),
        # a run that tried and got something is finished, even if it was not enough
        F.when(goes_on, RUNNING).when(nothing, FAILED).otherwise(FINISHED).alias("status"),
        F.when(nothing, F.lit(FAST_NO_RESULTS)).alias("error"),
    )


def fast_path_errors(entities: DataFrame, answers: DataFrame, config: RunConfig) -> DataFrame:
    """Why vendor answers brought nothing, one row per link."""
    requests = fetch.fast_path_requests(tables.valid_entities(entities), config.fast_path.domains)
    return fetch.failure_reasons(requests.select("entity_id", "url").join(answers, "url"))


# --- budget --------------------------------------------------------------------------------


def flow_with_budget(
    scrapes: DataFrame, second_attempt: DataFrame, fields: list[Field], config: RunConfig
) -> tuple[DataFrame, DataFrame]:
    """``(runs, values)``: entities whose fetching cost too much get a cheaper
    second attempt at their failed links; then extraction, validation and fusing.

    The branch is taken per entity by a join, not by the driver.
    """
    costs = metrics.scrape_cost_analysis(scrapes, by=("entity_id",)).select("entity_id", "total_cost")
    costs = costs.withColumn("budget_mode", F.col("total_cost") > config.budget_cost)
    dear = costs.filter("budget_mode").select("entity_id")
    again = fetch.retry_set(scrapes).join(dear, "entity_id", "left_semi")
    second = second_attempt.join(again, fetch.KEY, "left_semi")
    merged = fetch.merge_attempts(scrapes, second)
    gated = fetch.size_gate(merged, config.min_page_chars).withColumn(
        "data", F.when(F.col("passed") & fetch.is_extractable(), F.col("data"))
    )
    # one pass: rows without data keep their status and simply find nothing
    keep = ["entity_id", "url", "status", "data", "passed"]
    done = extract.with_content(gated.select(*keep), fields, config)
    results = hand_over(done.select("entity_id", "url", "status", "passed", "success", "content"))
    per = results.groupBy("entity_id").agg(
        F.count_if(F.col("status") == "ready").alias("successful_scrapes"),
        F.count_if((F.col("status") == "ready") & ~F.coalesce("passed", F.lit(False))).alias("scrapes_too_small"),
        F.count_if("success").alias("successful_extractions"),
    )
    ok = F.col("successful_extractions") > 0
    runs = costs.join(per, "entity_id").select(
        "entity_id",
        "total_cost",
        "budget_mode",
        "successful_scrapes",
        "scrapes_too_small",
        "successful_extractions",
        F.when(ok, FINISHED).otherwise(FAILED).alias("status"),
        F.when(F.col("successful_scrapes") == 0, F.lit(NO_SCRAPES)).when(~ok, F.lit(NO_EXTRACTS)).alias("error"),
    )
    return runs, fused_values(results, config)


# --- smaller jobs ----------------------------------------------------------------------------


def profile_run(times: DataFrame) -> DataFrame:
    """Statistics of every phase with limits, concern and advice."""
    return timing.judged_phases(timing.phase_statistics(times))


def compare_strategies(pages: DataFrame, label_words: list[str], fields: list[Field]) -> DataFrame:
    """All filter strategies measured against the blocks with a label word, and ranked."""
    return extract.strategy_ranking(extract.score_strategies(pages, fields, extract.STRATEGIES, label_words))


def host_profile(pages: DataFrame, fields: list[Field], min_chars: int) -> DataFrame:
    """The most trusted value of each field per host, with what the host offers.

    Pages below ``min_chars`` are not read but counted in ``n_gated``; a host where
    nothing is found has one row without a field.
    """
    valid = pages.filter(urls.is_valid_url(F.col("url"))).withColumn("n_chars", F.length("html"))
    passed = F.coalesce(F.col("n_chars") >= min_chars, F.lit(False))
    rows = valid.select(
        urls.host(F.col("url")).alias("entity_id"),
        "url",
        F.when(passed, F.col("n_chars")).alias("n_chars"),
        passed.alias("passed"),
        F.when(passed, extract.parsed(fields, F.col("html"), F.col("html"))).alias("content"),
    )
    sizes = rows.groupBy("entity_id").agg(
        F.count_if("passed").alias("n_pages"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.count_if(~F.col("passed")).alias("n_gated")
    )
    fused = gather.fuse(extract.value_rows(rows))
    return sizes.join(fused, "entity_id", "left").withColumnRenamed("entity_id", "host").select("host", *fused.drop("entity_id").columns, *sizes.columns[1:])


# --- run log -------------------------------------------------------------------------------


def log_tables(run: Run, entities: DataFrame, fields: list[Field], started, finished) -> dict[str, DataFrame]:
    """A finished run as log tables: bodies are left out, everything else is kept."""
    day = F.lit(started).cast("date").alias("run_date")
    as_run = F.col("entity_id").alias("run_id")
    found, scraped, extracted = F.col("urls_found"), F.col("urls_scraped"), F.col("urls_extracted")
    flat = (
        run.runs.join(run.costs, "entity_id")
        .join(queries_of(entities).withColumnRenamed("name", "query"), "entity_id", "left")
        .withColumn("run_id", F.col("entity_id"))
        .withColumn("success", F.col("status") == FINISHED)
        .withColumn("urls_failed", found - scraped)  # links that could not be fetched
        .withColumn("successful_scrapes", scraped)
        .withColumn("successful_extractions", extracted)
        .withColumn("scrape_success_rate", rate(scraped, found))
        .withColumn("extraction_success_rate", rate(extracted, scraped))
        .withColumn("overall_success_rate", rate(extracted, found))
        .withColumn("created_at", F.lit(started))
        .withColumn("completed_at", F.lit(finished))
    )
    results = run.results
    return {
        log.RUNS: log.run_records(flat, fields),
        log.HITS: run.links.select(as_run, "url", "channel", "pos", day),
        log.SCRAPES: results.select(
            as_run, "url", F.col("fetched").alias("success"), "status", urls.host(F.col("url")).alias("root_domain"),
            F.coalesce("n_chars", F.lit(0)).alias("data_size"), "error", day,
        ),
        log.EXTRACTS: results.filter("passed").select(
            as_run, "url", "success", F.to_json("content").alias("content"), "error", "stage_tokens", "strategy", "trimmed_to", day
        ),
        log.VALUES: run.values.select(as_run, "field", "value", "confidence", "votes", "source_url", day),
        log.ERRORS: results.filter(F.col("error").isNotNull()).select(as_run, "url", F.col("error").alias("message"), day),
    }


def write_log(tables: dict[str, DataFrame], root: str, mode: str = "test") -> str:
    """Append to the production or test log below ``root``; returns where it is."""
    path = log.log_path(root, mode)
    log.write_log(tables, path)
    return path


def read_log(spark: SparkSession, path: str, run_id: int | None = None, names=(log.RUNS, log.SCRAPES, log.EXTRACTS)):
    return log.read_log(spark, path, run_id, names)
