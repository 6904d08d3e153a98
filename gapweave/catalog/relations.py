"""Joins (J), aggregates (A), ordered values (W, T) and set operations (U0)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fetch, gather, hits, link_filter, metrics, running, timing
from ..session import scratch_dir
from ..sources import store, tables
from .base import STAGE_TIMES_SQL, Catalog, shape, stage_times

catalog = Catalog()
add = catalog.add


# --- joins ----------------------------------------------------------------------


@add(
    "j1_fetch",
    """SELECT h.entity_id, h.channel, h.link AS url, p.url IS NOT NULL AS success,
       CASE WHEN p.url IS NULL THEN 'failed' ELSE 'ready' END AS status, 0.0::DOUBLE AS cost,
       CASE WHEN p.url IS NULL THEN 'No page was fetched' END AS error, length(p.html) AS n_chars
       FROM hits h LEFT JOIN pages p ON h.link = p.url""",
    "hits",
)
def j1(spark, folder):
    requests = shape(spark, folder, "hits").select("entity_id", "channel", F.col("link").alias("url"))
    got = fetch.fetch(requests, tables.table(spark, folder, "pages"))
    return got.select(
        "entity_id", "channel", "url", "success", "status", "cost", "error", F.length("data").alias("n_chars")
    )


@add(
    "j1_bucketed_fetch",
    """SELECT h.entity_id, h.channel, h.link AS url, CASE WHEN p.url IS NULL THEN 'failed' ELSE 'ready' END AS status, length(p.html) AS n_chars
       FROM hits h LEFT JOIN pages p ON h.link = p.url""",
    "hits",
)
def j1_bucketed(spark, folder):
    requests = shape(spark, folder, "hits").select("entity_id", "channel", F.col("link").alias("url"))
    name = f"pages_{uuid.uuid4().hex}"
    kept = store.save_store(tables.table(spark, folder, "pages").select("url", "html"), name, scratch_dir(spark))
    return fetch.fetch(requests, kept).select("entity_id", "channel", "url", "status", F.length("data").alias("n_chars"))


@add("j1_asked_pages", "SELECT url, length(html) AS n_chars FROM pages WHERE url IN (SELECT link FROM hits)", "hits")
def j1_asked(spark, folder):
    links = shape(spark, folder, "hits").select(F.col("link").alias("url"))
    return link_filter.asked_pages(tables.table(spark, folder, "pages"), links).select("url", F.length("html").alias("n_chars"))


def _sides(spark, folder):
    t = stage_times(spark, folder)
    scrapes = t.select("run_id", "url", F.col("request_sent").alias("scrape_start"), F.col("data_received").alias("scrape_end"))
    extracts = t.filter(F.col("filter_requested").isNotNull()).select(
        "run_id", "url", F.col("filter_requested").alias("extract_start"), F.col("parse_completed").alias("extract_end")
    )
    return scrapes, extracts


@add(
    "j2_url_delays",
    f"SELECT run_id, url, step * 1 / 1e6 AS delay, step * 20 / 1e6 AS processing_time FROM {STAGE_TIMES_SQL} WHERE extracted",
)
def j2(spark, folder):
    return timing.url_delays(*_sides(spark, folder))


@add(
    "j3_entity_domains",
    """SELECT d.domain, count(*) AS n_requests, count(DISTINCT d.base || name) AS n_links FROM entities,
       (VALUES ('digikey', 'https://www.digikey.com/en/products/result?keywords='),
               ('mouser', 'https://www.mouser.com/Search/Refine?Keyword=')) d(domain, base)
       WHERE trim(name) <> '' GROUP BY d.domain""",
    "entities",
)
def j3(spark, folder):
    e = tables.valid_entities(shape(spark, folder, "entities"))
    requests = fetch.fast_path_requests(e, ("digikey", "mouser"))
    return requests.groupBy("domain").agg(F.count("*").alias("n_requests"), F.count_distinct("url").alias("n_links"))


@add("j4_retry_set", "SELECT entity_id, url FROM scrapes WHERE status <> 'ready'", "scrapes")
def j4(spark, folder):
    return fetch.retry_set(shape(spark, folder, "scrapes"))


MERGED = """(SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.url, b.url) AS url,
    CASE WHEN a.url IS NULL OR (a.status <> 'ready' AND b.status = 'ready') THEN b.status ELSE a.status END AS status,
    CASE WHEN a.url IS NULL OR (a.status <> 'ready' AND b.status = 'ready') THEN b.cost ELSE a.cost END AS cost,
    CASE WHEN a.url IS NULL OR (a.status <> 'ready' AND b.status = 'ready') THEN b.data ELSE a.data END AS data
    FROM scrapes a FULL JOIN second_scrapes b ON a.entity_id = b.entity_id AND a.url = b.url)"""


@add("j5_merge_attempts", f"SELECT entity_id, url, status, cost, length(data) AS n_chars FROM {MERGED}", "scrapes second_scrapes")
def j5(spark, folder):
    merged = fetch.merge_attempts(shape(spark, folder, "scrapes"), shape(spark, folder, "second_scrapes"))
    return merged.select("entity_id", "url", "status", "cost", F.length("data").alias("n_chars"))


@add(
    "j6_fast_path_routing",
    """WITH+ good AS (SELECT DISTINCT entity_id FROM contents WHERE success AND data_kind = 'json'
           AND coalesce(CASE WHEN NOT json_valid(j) THEN length(j) > 0 WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) > 0
               WHEN json_type(j) = 'OBJECT' THEN len(json_keys(j)) > 0 WHEN json_type(j) = 'NULL' THEN false
               ELSE length(j) > 0 END, false))
       SELECT entity_id, CASE WHEN entity_id IN (SELECT entity_id FROM good) THEN 'fast' ELSE 'normal' END AS path
       FROM entities""",
    "entities contents",
)
def j6(spark, folder):
    entities = shape(spark, folder, "entities").select("entity_id")
    answers = shape(spark, folder, "contents").withColumnRenamed("j", "data")
    served, remaining = fetch.route(entities, fetch.fast_path_outcome(answers, min_size=1000))
    return served.withColumn("path", F.lit("fast")).unionByName(remaining.withColumn("path", F.lit("normal")))


VOTES = """votes AS (SELECT entity_id, field, value, count(*) AS votes, max(confidence) AS confidence,
      arg_min(url, (-confidence, url)) AS source_url
    FROM (SELECT *, CAST(doc_id AS VARCHAR) AS url FROM "values") WHERE value IS NOT NULL GROUP BY 1, 2, 3),
  fused AS (SELECT entity_id, field, arg_max(value, (confidence, votes, value)) AS value,
      max(confidence) AS confidence, arg_max(votes, (confidence, votes, value)) AS votes,
      arg_max(source_url, (confidence, votes, value)) AS source_url FROM votes GROUP BY 1, 2)"""


def _values(spark, folder):
    return shape(spark, folder, "values").withColumn("url", F.col("doc_id").cast("string")).drop("doc_id")


@add(
    "j7_impute",
    f"""WITH+ {VOTES}, wide AS (SELECT entity_id, max(CASE WHEN field = 'lang' THEN value END) AS l,
          max(CASE WHEN field = 'lang' THEN source_url END) AS ls, max(CASE WHEN field = 'quality' THEN value END) AS q,
          max(CASE WHEN field = 'quality' THEN source_url END) AS qs FROM fused GROUP BY 1)
        SELECT doc_id, entity_id, coalesce(lang, l) AS lang, coalesce(quality, q) AS quality,
          CASE WHEN lang IS NULL THEN ls END AS lang_source, CASE WHEN quality IS NULL THEN qs END AS quality_source
        FROM gaps LEFT JOIN wide USING (entity_id)""",
    "values gaps",
)
def j7(spark, folder):
    return gather.impute(shape(spark, folder, "gaps"), gather.fuse(_values(spark, folder)), ["lang", "quality"])


REQUESTS = """requests AS (SELECT event_id, ts, event_type AS query, user_id % 3 AS top_k FROM events WHERE event_type <> 'purchase'),
   cache AS (SELECT ts AS cached_at, event_type AS query, user_id % 3 AS top_k FROM events WHERE value > 60)"""


@add(
    "j8_uncached_requests",
    f"""WITH {REQUESTS} SELECT event_id, query, top_k, ts FROM requests r WHERE NOT EXISTS (
        SELECT 1 FROM cache c WHERE c.query = r.query AND c.top_k = r.top_k
          AND r.ts >= c.cached_at AND r.ts - c.cached_at <= INTERVAL 1 HOUR)""",
)
def j8(spark, folder):
    e = tables.table(spark, folder, "events").select(
        "event_id", "ts", "value", F.col("event_type").alias("query"), (F.col("user_id") % 3).alias("top_k")
    )
    requests = e.filter(F.col("query") != "purchase").select("event_id", "query", "top_k", "ts")
    cache = e.filter(F.col("value") > 60).select(F.col("ts").alias("cached_at"), "query", "top_k")
    return hits.uncached_requests(requests, cache)


# --- aggregates -------------------------------------------------------------------


@add(
    "a1_channel_statistics",
    """WITH+ h AS (SELECT channel, count(*) AS results, arg_min(title, (channel_rank, link)) AS top_result FROM hits GROUP BY 1),
         u AS (SELECT channel, sum(cost) AS cost, sum(elapsed) AS elapsed FROM channel_usage GROUP BY 1)
       SELECT channel, results, round(cost, 6) AS cost, round(elapsed, 6) AS elapsed, 1 AS channels, top_result FROM u JOIN h USING (channel)
       UNION ALL SELECT '(all)', sum(results)::BIGINT, round(sum(cost), 6), round(sum(elapsed), 6), count(*), NULL FROM u JOIN h USING (channel)""",
    "hits channel_usage",
)
def a1(spark, folder):
    return metrics.channel_statistics(shape(spark, folder, "hits"), shape(spark, folder, "channel_usage"))


@add(
    "a2_scrape_costs",
    """SELECT round(sum(cost), 6) AS total_cost, round(sum(cost) FILTER (success), 6) AS successful_scrapes_cost,
       round(round(sum(cost) * 1e6) / count(cost)) / 1e6 AS avg_cost_per_scrape,
       round(round(sum(cost) FILTER (success) * 1e6) / count(cost) FILTER (success)) / 1e6 AS avg_cost_per_successful,
       'Scraping cost: $' || (t // 10000) || '.' || lpad((t % 10000)::VARCHAR, 4, '0') AS summary
       FROM scrapes, (SELECT (sum(CAST(round(cost * 1000000) AS BIGINT))::BIGINT + 50) // 100 AS t FROM scrapes) GROUP BY t""",
    "scrapes",
)
def a2(spark, folder):
    return metrics.scrape_cost_text(metrics.scrape_costs(shape(spark, folder, "scrapes")))


ANALYSIS = """round(sum(c), 6) AS total_cost, count(*) FILTER (status = 'ready') AS successful_scrapes,
    count(*) FILTER (status <> 'ready') AS failed_scrapes, count(*) AS total_urls,
    round(avg(CASE WHEN status = 'ready' THEN 1.0 ELSE 0 END), 6) AS success_rate, round(round(sum(c) * 1e6) / count(*)) / 1e6 AS avg_cost_per_url,
    round(round(sum(c) * 1e6) / count(*) FILTER (status = 'ready')) / 1e6 AS avg_cost_per_success,
    (sum(length(data)) FILTER (status = 'ready'))::BIGINT AS total_characters,
    round((sum(length(data)) FILTER (status = 'ready'))::DOUBLE / count(*) FILTER (status = 'ready'), 6) AS avg_chars_per_success,
    arg_min(url, (-c, url)) AS most_expensive_url, arg_min(url, (c, url)) AS cheapest_url"""
COSTED = "(SELECT *, coalesce(cost, 0) AS c FROM scrapes)"


@add("a3_scrape_cost_analysis", f"SELECT {ANALYSIS} FROM {COSTED}", "scrapes")
def a3(spark, folder):
    return metrics.scrape_cost_analysis(shape(spark, folder, "scrapes"))


@add("a3_scrape_cost_by_entity", f"SELECT entity_id, {ANALYSIS} FROM {COSTED} GROUP BY entity_id", "scrapes")
def a3_by_entity(spark, folder):
    return metrics.scrape_cost_analysis(shape(spark, folder, "scrapes"), by=("entity_id",))


@add("a3_costs_by_url", "SELECT entity_id, url, coalesce(cost, 0) AS cost FROM scrapes", "scrapes")
def a3_urls(spark, folder):
    return metrics.costs_by_url(shape(spark, folder, "scrapes"))


@add(
    "a4_run_metrics",
    """SELECT run_id, f AS urls_found, s AS successful_scrapes, x AS successful_extractions,
       coalesce(round(s / nullif(f, 0)::DOUBLE, 6), 0) AS scrape_success_rate,
       coalesce(round(x / nullif(s, 0)::DOUBLE, 6), 0) AS extraction_success_rate,
       coalesce(round(x / nullif(f, 0)::DOUBLE, 6), 0) AS overall_success_rate,
       round(fc, 6) AS serp_cost, round(sc, 6) AS scrape_cost, round(xc, 6) AS extraction_cost,
       round(fc + sc + xc, 6) AS total_cost, coalesce(round(round((fc + sc + xc) * 1e6) / nullif(x, 0)) / 1e6, 0) AS cost_per_successful_extraction
     FROM (SELECT run_id, count(*) FILTER (stage = 'found') AS f, count(*) FILTER (stage = 'scraped') AS s,
             count(*) FILTER (stage = 'extracted') AS x, coalesce(sum(CAST(round(cost * 1000000) AS BIGINT)) FILTER (stage = 'found') / 1e6, 0) AS fc,
             coalesce(sum(CAST(round(cost * 1000000) AS BIGINT)) FILTER (stage = 'scraped') / 1e6, 0) AS sc, coalesce(sum(CAST(round(cost * 1000000) AS BIGINT)) FILTER (stage = 'extracted') / 1e6, 0) AS xc
           FROM run_events GROUP BY run_id)""",
    "run_events",
)
def a4(spark, folder):
    return metrics.run_metrics(shape(spark, folder, "run_events")).drop("urls_failed", "created_at", "completed_at")


@add(
    "a5_cost_extremes",
    """SELECT run_id, arg_min(url, (-cost, url)) AS most_expensive_url,
       min(cost) FILTER (stage = 'extracted') AS cheapest_successful_extraction, round(sum(cost), 6) > 10 AS cost_threshold_exceeded,
       coalesce(round(sum(CAST(round(cost * 1000000) AS BIGINT)) / nullif(count(*) FILTER (stage = 'extracted'), 0)) / 1e6, 0) AS cost_per_result
       FROM run_events GROUP BY run_id""",
    "run_events",
)
def a5(spark, folder):
    return metrics.cost_extremes(shape(spark, folder, "run_events"), 10.0)


def _stages(spark, folder):
    return stage_times(spark, folder).select(
        "run_id",
        "url",
        F.col("request_sent").alias("scrape_start"),
        F.col("data_received").alias("scrape_end"),
        F.col("filter_requested").alias("extract_start"),
        F.col("parse_completed").alias("extract_end"),
    )


@add(
    "a6_stage_time_statistics",
    f"""SELECT run_id, round(avg(s * 1e6)) / 1e6 AS avg_scrape_time, min(s) AS min_scrape_time, max(s) AS max_scrape_time,
        coalesce(round(stddev_samp(s), 6), 0) AS std_scrape_time, round(avg(x * 1e6)) / 1e6 AS avg_extract_time, min(x) AS min_extract_time,
        max(x) AS max_extract_time, coalesce(round(stddev_samp(x), 6), 0) AS std_extract_time
        FROM (SELECT run_id, step * 4 / 1e6 AS s, CASE WHEN extracted THEN step * 15 / 1e6 END AS x FROM {STAGE_TIMES_SQL}) GROUP BY run_id""",
)
def a6(spark, folder):
    return timing.stage_time_statistics(_stages(spark, folder))


def _extracts(spark, folder):
    """Pages long enough to be extracted; those with few characters failed."""
    rows = fetch.extractable(shape(spark, folder, "scrapes"))
    return rows.select("entity_id", "url", (F.length("data") >= 3000).alias("success"))


EXTRACTS = "x AS (SELECT entity_id, url, length(data) >= 3000 AS success FROM scrapes WHERE status = 'ready' AND length(data) > 0)"


@add(
    "a7_run_outcome",
    f"""WITH+ {EXTRACTS}, o AS (SELECT s.entity_id, coalesce(bool_or(x.success), false) AS success
          FROM scrapes s LEFT JOIN x USING (entity_id, url) GROUP BY 1)
        SELECT entity_id, success, CASE WHEN success THEN 'finished' ELSE 'failed' END AS status FROM o""",
    "scrapes",
)
def a7(spark, folder):
    return metrics.run_outcome(shape(spark, folder, "scrapes"), _extracts(spark, folder))


@add(
    "a8_stage_counters",
    """SELECT run_id, greatest(0, count(*) FILTER (stage = 'scraping') - count(*) FILTER (stage = 'scraped')) AS urls_scraping,
       count(*) FILTER (stage = 'scraped') AS urls_scraped,
       greatest(0, count(*) FILTER (stage = 'extracting') - count(*) FILTER (stage = 'extracted')) AS urls_extracting,
       count(*) FILTER (stage = 'extracted') AS urls_extracted, count(*) FILTER (stage = 'failed') AS urls_failed,
       count(*) FILTER (stage = 'found') AS urls_found FROM run_events GROUP BY run_id""",
    "run_events",
)
def a8(spark, folder):
    return metrics.stage_counters(shape(spark, folder, "run_events")).drop("total_cost", "seconds")


@add(
    "a9_result_counters",
    f"""WITH+ {EXTRACTS} SELECT s.entity_id, count(DISTINCT s.url) AS total_urls_scraped,
        count(*) FILTER (s.status = 'ready') AS successful_scrapes, count(*) FILTER (x.success) AS successful_extractions
        FROM scrapes s LEFT JOIN x USING (entity_id, url) GROUP BY 1""",
    "scrapes",
)
def a9(spark, folder):
    return metrics.result_counters(shape(spark, folder, "scrapes"), _extracts(spark, folder))


@add(
    "a10_confident_values",
    """SELECT entity_id, field, value, confidence, CAST(doc_id AS VARCHAR) AS url FROM "values" v JOIN
       (SELECT entity_id, CASE WHEN count(*) FILTER (confidence >= 0.97) >= 3 THEN 0.97 ELSE 0.5 END AS lim FROM "values" GROUP BY 1) l
       USING (entity_id) WHERE confidence >= lim""",
    "values",
)
def a10(spark, folder):
    return gather.confident_values(_values(spark, folder), 0.97, 0.5, 3)


@add("a11_fuse_values", f"WITH+ {VOTES} SELECT entity_id, field, value, confidence, votes, source_url FROM fused", "values")
def a11(spark, folder):
    return gather.fuse(_values(spark, folder))


@add(
    "a12_agreement",
    f"""WITH+ {VOTES} SELECT entity_id, field, count(*) AS distinct_values, sum(votes)::BIGINT AS n_values,
        arg_max(value, (votes, value)) AS top_value, round(max(votes) / sum(votes), 6) AS agreement FROM votes GROUP BY 1, 2""",
    "values",
)
def a12(spark, folder):
    return gather.agreement(_values(spark, folder))


@add(
    "a12_approximate_agreement",
    'SELECT entity_id, field, count(DISTINCT value) AS distinct_values FROM "values" WHERE value IS NOT NULL GROUP BY 1, 2',
    "values",
)
def a12_approx(spark, folder):
    return gather.approximate_agreement(_values(spark, folder))


@add(
    "a12_united_sketches",
    """SELECT event_type AS field, count(DISTINCT CAST(ts AS DATE)) AS n_sketches, count(DISTINCT user_id) AS exact, true AS within_bound
       FROM events GROUP BY event_type""",
)
def a12_united(spark, folder):
    events = tables.table(spark, folder, "events").withColumn("day", F.to_date("ts")).withColumnRenamed("event_type", "field")
    path = scratch_dir(spark)
    # stored by day; a later reader unites as many days as it likes
    gather.value_sketches(events, ["field", "day"], "user_id").write.partitionBy("day").parquet(path)
    counts = gather.united_counts(spark.read.parquet(path), ["field"])
    exact = events.groupBy("field").agg(F.count_distinct("user_id").alias("exact"))
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= F.ceil(F.col("exact") * gather.SKETCH_ERROR)
    return counts.join(exact, "field").select("field", "n_sketches", "exact", close.alias("within_bound"))


@add(
    "a13_streaming_metrics",
    f"""SELECT run_id, 1.0::DOUBLE AS scrape_success_rate,
        CASE WHEN bool_or(extracted) THEN 1.0::DOUBLE ELSE 0 END AS extract_success_rate,
        round(count(*) FILTER (extracted) / count(*)::DOUBLE, 6) AS overall_success_rate,
        round(avg(step * 20) FILTER (extracted)) / 1e6 AS avg_url_processing_time,
        min(step * 20 / 1e6) FILTER (extracted) AS fastest_url_time, max(step * 20 / 1e6) FILTER (extracted) AS slowest_url_time
        FROM {STAGE_TIMES_SQL} GROUP BY run_id""",
)
def a13(spark, folder):
    return timing.streaming_metrics(_stages(spark, folder))


@add(
    "a14_overlap",
    f"""SELECT run_id, min(t0 + 5 * step) FILTER (extracted) < max(t0 + 4 * step) AS streaming_extraction,
        round((max(t0 + 4 * step) - min(t0 + 5 * step) FILTER (extracted)) / 1e6, 6) AS time_saved,
        coalesce(round(avg(step) FILTER (extracted)) / 1e6, 0) AS avg_delay
        FROM {STAGE_TIMES_SQL} GROUP BY run_id HAVING bool_or(extracted)""",
)
def a14(spark, folder):
    return timing.overlap(_stages(spark, folder))


@add(
    "a15_time_to_first_result",
    f"""SELECT run_id, round((min(t0 + 20 * step) FILTER (extracted) - min(t0)) / 1e6, 6) AS time_to_first_result
        FROM {STAGE_TIMES_SQL} GROUP BY run_id""",
)
def a15(spark, folder):
    return timing.time_to_first_result(_stages(spark, folder))


# phase, steps it takes, whether only extracted links have it
PHASES_SQL = """(VALUES ('request_to_snapshot', 1, false), ('snapshot_to_poll', 1, false), ('poll_to_data', 2, false),
    ('total_scrape_time', 4, false), ('filter_request_to_enqueue', 1, true), ('filter_enqueue_to_dequeue', 2, true),
    ('filter_dequeue_to_complete', 3, true), ('parse_request_to_enqueue', 1, true), ('parse_enqueue_to_dequeue', 2, true),
    ('parse_dequeue_to_convertstart', 1, true), ('parse_converttodict_duration', 1, true), ('parse_convertend_to_complete', 3, true),
    ('filter_total_time', 6, true), ('parse_total_time', 8, true), ('filter_to_parse_gap', 7, true)) p(phase, steps, late)"""
PHASE_STATS = f"""(SELECT phase, count(*) AS n, min(steps * step / 1e6) AS min, max(steps * step / 1e6) AS max,
    round(avg(steps * step)) / 1e6 AS avg, round(stddev_samp(steps * step / 1e6), 6) AS std
    FROM {STAGE_TIMES_SQL}, {PHASES_SQL} WHERE extracted OR NOT late GROUP BY phase)"""


@add("a16_phase_statistics", f"SELECT * FROM {PHASE_STATS}")
def a16(spark, folder):
    return timing.phase_statistics(stage_times(spark, folder))


@add(
    "a16_phase_rows",
    f"""SELECT run_id, url, phase, steps * step / 1e6 AS seconds FROM {STAGE_TIMES_SQL}, {PHASES_SQL} WHERE extracted OR NOT late""",
)
def a16_rows(spark, folder):
    return timing.phase_rows(stage_times(spark, folder))


@add(
    "a17_slow_phases",
    f"""SELECT phase, max AS max_duration, avg AS avg_duration, threshold,
        CASE WHEN max > threshold * CASE WHEN threshold = 10 THEN 3 ELSE 5 END THEN 'high' ELSE 'medium' END AS concern_level,
        recommendation FROM {PHASE_STATS} JOIN (VALUES
          ('request_to_snapshot', 10.0::DOUBLE, 'Pages come in slowly: raise the number of parallel fetches or shorten their timeout'),
          ('snapshot_to_poll', 10.0, 'Pages come in slowly: raise the number of parallel fetches or shorten their timeout'),
          ('poll_to_data', 10.0, 'Pages come in slowly: raise the number of parallel fetches or shorten their timeout'),
          ('total_scrape_time', 10.0, 'Pages come in slowly: raise the number of parallel fetches or shorten their timeout'),
          ('parse_converttodict_duration', 0.1, 'Converting answers takes long: move it off the thread that waits for them'),
          ('filter_enqueue_to_dequeue', 1.0, 'Calls wait in the queue: allow the model service more calls at once'),
          ('parse_enqueue_to_dequeue', 1.0, 'Calls wait in the queue: allow the model service more calls at once'),
          ('filter_to_parse_gap', 0.1, NULL)) t(phase, threshold, recommendation) USING (phase) WHERE max > threshold""",
)
def a17(spark, folder):
    return timing.slow_phases(timing.phase_statistics(stage_times(spark, folder)))


MESSAGES = """(SELECT entity_id, url, substr(url, 1, 50) || '...: ' || CASE WHEN NOT success THEN coalesce(error, 'Unknown error')
      ELSE 'No data returned' END AS message FROM scrapes WHERE NOT success OR data IS NULL OR data = ''
    UNION ALL SELECT entity_id, url, 'Scrape for ' || substr(url, 1, 40) || '... too small: ' || length(data) || ' chars'
      FROM scrapes WHERE status = 'ready' AND length(data) > 0 AND length(data) < 1000)"""


@add(
    "a18_errors",
    f"""SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY url, message) AS nr, message AS text FROM {MESSAGES}""",
    "scrapes",
)
def a18(spark, folder):
    messages = metrics.error_messages(shape(spark, folder, "scrapes"), 1000)
    return fetch.numbered_texts(messages, ["entity_id"], "url", "message")


@add(
    "a19_cost_breakdown",
    """SELECT run_id, stage, round(sum(cost), 6) AS cost, count(*) AS n, grouping_id(run_id, stage) AS level
       FROM run_events GROUP BY ROLLUP (run_id, stage)""",
    "run_events",
)
def a19(spark, folder):
    return metrics.cost_breakdown(shape(spark, folder, "run_events"))


# --- ordered values -----------------------------------------------------------------

MIXED = """mixed AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY channel_rank, channel_order) AS pos FROM hits)"""


@add(
    "w1_first_per_link",
    f"""WITH+ {MIXED} SELECT entity_id, link, channel, pos FROM mixed
        QUALIFY row_number() OVER (PARTITION BY entity_id, link ORDER BY pos) = 1""",
    "hits",
)
def w1(spark, folder):
    return hits.first_per_link(hits.interleave(shape(spark, folder, "hits"))).select("entity_id", "link", "channel", "pos")


@add("w2_interleave", f"WITH+ {MIXED} SELECT entity_id, channel, channel_rank, link, pos FROM mixed", "hits")
def w2(spark, folder):
    return hits.interleave(shape(spark, folder, "hits")).select("entity_id", "channel", "channel_rank", "link", "pos")


VALID_LINK = r"""regexp_matches(link, '^https?://') AND NOT regexp_matches(lower(link),
      'facebook\.com|twitter\.com|instagram\.com|tiktok\.com|youtube\.com|pinterest\.com|reddit\.com')
    AND NOT regexp_matches(regexp_replace(link, '[?#].*$', ''), '(?i)\.(pdf|docx?|xlsx?|pptx?|zip)$')"""
SELECTED = f"""once AS (SELECT * FROM hits WHERE {VALID_LINK}
    QUALIFY row_number() OVER (PARTITION BY entity_id, link ORDER BY channel_rank, channel_order, link) = 1),
  picked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY channel_rank, channel_order, link) AS pos FROM once
    QUALIFY pos <= 10)"""


@add("w3_select_links", f"WITH+ {SELECTED} SELECT entity_id, link, channel, channel_rank, pos FROM picked", "hits")
def w3(spark, folder):
    return hits.select_links(shape(spark, folder, "hits"), 10).select("entity_id", "link", "channel", "channel_rank", "pos")


@add(
    "w3_trim_channels",
    """SELECT entity_id, channel, link, row_number() OVER (PARTITION BY entity_id, channel ORDER BY channel_rank, link) AS pos
       FROM hits QUALIFY pos <= 5""",
    "hits",
)
def w3_channels(spark, folder):
    return hits.trim_channels(shape(spark, folder, "hits"), 5).select("entity_id", "channel", "link", "pos")


@add(
    "w4_running_cost",
    """WITH+ r AS (SELECT *, sum(CAST(cost AS DECIMAL(20,6))) OVER (PARTITION BY run_id ORDER BY ts, url) AS s FROM run_events)
       SELECT run_id, event_id, s::DOUBLE AS running_cost, s > 5 AS over_budget,
         s > 5 AND s - CAST(cost AS DECIMAL(20,6)) <= 5 AS is_cut FROM r""",
    "run_events",
)
def w4(spark, folder):
    done = metrics.running_cost(shape(spark, folder, "run_events"), 5)
    return done.select("run_id", "event_id", "running_cost", "over_budget", "is_cut")


@add(
    "w7_event_gaps",
    """SELECT run_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY ts, event_id)) / 1e6 AS gap_seconds
       FROM run_events""",
    "run_events",
)
def w7(spark, folder):
    return metrics.event_gaps(shape(spark, folder, "run_events")).select("run_id", "event_id", "gap_seconds")


@add(
    "w8_cost_rank",
    """SELECT entity_id, url, coalesce(cost, 0) AS cost,
       rank() OVER (PARTITION BY entity_id ORDER BY coalesce(cost, 0) DESC) AS rank,
       dense_rank() OVER (PARTITION BY entity_id ORDER BY coalesce(cost, 0) DESC) AS dense_rank FROM scrapes""",
    "scrapes",
)
def w8(spark, folder):
    return metrics.cost_rank(shape(spark, folder, "scrapes"))


@add(
    "t1_first_links",
    "SELECT entity_id, channel, channel_rank, link FROM hits ORDER BY channel_rank, channel_order, entity_id LIMIT 25",
    "hits",
)
def t1(spark, folder):
    return hits.first_links(shape(spark, folder, "hits"), 25).select("entity_id", "channel", "channel_rank", "link")


@add(
    "t2_first_results",
    f"""WITH+ {EXTRACTS} SELECT entity_id, url, success, row_number() OVER (PARTITION BY entity_id ORDER BY url) AS pos,
        greatest(0, count(*) OVER (PARTITION BY entity_id) - 3) AS more FROM x QUALIFY pos <= 3""",
    "scrapes",
)
def t2(spark, folder):
    return metrics.first_results(_extracts(spark, folder))


@add(
    "t3_list_positions",
    f"""WITH+ {MIXED}, f AS (SELECT entity_id, link, min(pos) AS pos FROM mixed GROUP BY 1, 2)
        SELECT entity_id, link, pos, min(pos) OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS next_pos
        FROM f""",
    "hits",
)
def t3(spark, folder):
    """The list order survives deduplication: each link knows the next position."""
    links = hits.first_per_link(hits.interleave(shape(spark, folder, "hits"))).select("entity_id", "link", "pos")
    back = links.withColumn("back", -F.col("pos"))
    done = running.previous_value(back, ["entity_id"], ["back"], "pos", "next_pos")
    return done.drop("back")


# --- set operations ---------------------------------------------------------------


@add(
    "u0a_update_rows",
    """SELECT entity_id, url, status, cost FROM second_scrapes UNION ALL
       SELECT entity_id, url, status, cost FROM scrapes s WHERE NOT EXISTS (
         SELECT 1 FROM second_scrapes t WHERE t.entity_id = s.entity_id AND t.url = s.url)""",
    "scrapes second_scrapes",
)
def u0a(spark, folder):
    columns = ["entity_id", "url", "status", "cost"]
    first, second = (shape(spark, folder, n).select(*columns) for n in ("scrapes", "second_scrapes"))
    return fetch.update_rows(first, second, fetch.KEY)


@add(
    "u0b_both_paths",
    """SELECT 'normal' AS path, entity_id, url, status, cost, NULL AS domain FROM scrapes
       UNION ALL SELECT 'fast', entity_id, 'https://www.digikey.com/en/products/result?keywords=' || name, 'ready', 0.0025, 'digikey'
       FROM entities WHERE trim(name) <> ''""",
    "scrapes entities",
)
def u0b(spark, folder):
    normal = shape(spark, folder, "scrapes").select("entity_id", "url", "status", "cost")
    e = tables.valid_entities(shape(spark, folder, "entities"))
    fast = fetch.fast_path_requests(e, ("digikey",)).select(
        "entity_id", "url", F.lit("ready").alias("status"), F.lit(0.0025).alias("cost"), "domain"
    )
    return fetch.both_paths(normal, fast)


@add(
    "u0c_url_sets",
    f"""WITH+ {EXTRACTS} SELECT entity_id, url, CASE WHEN url IN (SELECT url FROM x) THEN 'both' ELSE 'scraped only' END AS found_in
        FROM scrapes""",
    "scrapes",
)
def u0c(spark, folder):
    scraped = shape(spark, folder, "scrapes").select("entity_id", "url")
    extracted = _extracts(spark, folder).select("entity_id", "url")
    both = scraped.intersect(extracted).withColumn("found_in", F.lit("both"))
    return both.unionByName(scraped.subtract(extracted).withColumn("found_in", F.lit("scraped only")))
