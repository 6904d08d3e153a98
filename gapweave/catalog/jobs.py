"""Whole jobs (JOB) as queries."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from ..config import MODE_FALLBACK, MODE_ONLY, FastPath, Field, RunConfig
from ..operators import log
from ..plans import jobs
from ..session import scratch_dir
from ..sources import tables
from ..streaming import streams
from .base import Catalog, shape, stage_times
from .extraction import (
    FIELDS,
    LABEL_WORDS,
    PICKED,
    SCORED,
    WORDS,
    blocks_sql,
    filtered_sql,
    flags_sql,
    long_rows,
)
from .projections import REDUCED, VALID
from .relations import PHASE_STATS

catalog = Catalog()
add = catalog.add

PROFILE_FIELDS = [f for f in FIELDS if f.on_page]
CONFIDENT = """counted AS (SELECT url, field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
  conf AS (SELECT url, field, value, n / (sum(n) OVER (PARTITION BY url, field))::DOUBLE AS confidence FROM counted),
  vals AS (SELECT entity_id, url, field, value, confidence FROM {links} JOIN conf USING (url)),
  lim AS (SELECT entity_id, CASE WHEN count(*) FILTER (confidence >= 0.7) >= 1 THEN 0.7 ELSE 0.5 END AS lim FROM vals GROUP BY 1),
  good AS (SELECT vals.* FROM vals JOIN lim USING (entity_id) WHERE confidence >= lim),"""
FUSED = """votes AS (SELECT entity_id, field, value, count(*) AS votes, max(confidence) AS confidence, arg_min(url, (-confidence, url)) AS source_url
    FROM {good} GROUP BY 1, 2, 3),
  fused AS (SELECT entity_id, field, arg_max(value, (confidence, votes, value)) AS value, max(confidence) AS confidence,
    arg_max(votes, (confidence, votes, value)) AS votes, arg_max(source_url, (confidence, votes, value)) AS source_url FROM votes GROUP BY 1, 2)"""


@add(
    "job0_host_profile",
    f"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS entity_id, url, html, coalesce(length(html) >= 3000, false) AS passed FROM pages WHERE {VALID}),
        m AS (SELECT * FROM ("""
    + " UNION ALL ".join(
        f"SELECT entity_id, url, '{f.name}' AS field, unnest(regexp_extract_all(html, '{f.pattern}', 1)) AS value FROM p WHERE passed" for f in PROFILE_FIELDS
    )
    + f""")), c AS (SELECT entity_id, url, field, value, count(*) AS n FROM m GROUP BY ALL),
        good AS (SELECT *, n / (sum(n) OVER (PARTITION BY url, field))::DOUBLE AS confidence FROM c), {FUSED.format(good='good')}
        SELECT entity_id AS host, field, value, confidence, votes, source_url, n_pages, n_chars, n_gated FROM fused
        RIGHT JOIN (SELECT entity_id, count(*) FILTER (passed) AS n_pages, coalesce(sum(length(html)) FILTER (passed), 0)::BIGINT AS n_chars,
          count(*) FILTER (NOT passed) AS n_gated FROM p GROUP BY 1) USING (entity_id)""",
)
def job0(spark, folder):
    return jobs.host_profile(tables.table(spark, folder, "pages"), PROFILE_FIELDS, 3000)


def _passages(spark, folder):
    """Passages as entities, each with a twin that nothing can be found for."""
    p = shape(spark, folder, "passages")
    twins = p.select((F.col("entity_id") + 1000000).alias("entity_id"), F.lit("###").alias("name"))
    null = F.lit(None).cast("string")
    return p.unionByName(twins).withColumn("identifier_context", null).withColumn("impute_task_purpose", null)


CONFIG = RunConfig(top_k=10, min_page_chars=1000)


def _run(spark, folder):
    return jobs.impute_batch(_passages(spark, folder), FIELDS, tables.table(spark, folder, "pages"), CONFIG)


EXTRACT_PAGES = f"""body AS (SELECT url, html AS raw, CASE WHEN length(html) > 10000 THEN {REDUCED.format('html')} ELSE html END AS data
    FROM pages WHERE length(html) >= 1000),
  {blocks_sql('body', 'data')}, {flags_sql(WORDS)},
  f AS (SELECT b.*, coalesce(k.filtered, '') AS filtered FROM body b
        LEFT JOIN (SELECT url, {filtered_sql('contextual')} AS filtered FROM flags GROUP BY url) k USING (url)),
  v AS (SELECT * FROM {long_rows('f', 'filtered', 'raw')})"""


@add(
    "job1_impute_batch",
    f"""WITH+ {PICKED}, links AS (SELECT entity_id, link AS url FROM picked), {EXTRACT_PAGES},
        {CONFIDENT.format(links='links')} {FUSED.format(good='good')}
        SELECT entity_id, field, value, confidence, votes, source_url FROM fused""",
    "passages",
)
def job1(spark, folder):
    return _run(spark, folder).values


@add(
    "job9_many_entities",
    f"""WITH+ passages AS (SELECT * FROM titles), {PICKED}, links AS (SELECT entity_id, link AS url FROM picked), {EXTRACT_PAGES},
        {CONFIDENT.format(links='links')} {FUSED.format(good='good')}
        SELECT entity_id, field, value, confidence, votes, source_url FROM fused""",
    "titles",
)
def job9(spark, folder):
    null = F.lit(None).cast("string")
    entities = shape(spark, folder, "titles").withColumns({"identifier_context": null, "impute_task_purpose": null})
    return jobs.impute_batch(entities, FIELDS, tables.table(spark, folder, "pages"), CONFIG).values


LOGGED = """SELECT '{0}' AS log_table, entity_id AS run_id, count(*) AS n FROM {1} GROUP BY 2"""


@add(
    "job5_log_run",
    f"""WITH+ {PICKED}, links AS (SELECT entity_id, link AS url FROM picked), {EXTRACT_PAGES},
        {CONFIDENT.format(links='links')} {FUSED.format(good='good')},
        valued AS (SELECT DISTINCT url FROM v WHERE value IS NOT NULL),
        long AS (SELECT links.*, length(html) AS n FROM links JOIN pages USING (url)),
        e AS (SELECT entity_id FROM passages UNION ALL SELECT entity_id + 1000000 FROM passages) """
    + " UNION ALL ".join(
        LOGGED.format(*x)
        for x in (
            ("runs", "e"),
            ("hits", "links"),
            ("scrapes", "links"),
            ("extracts", "(SELECT * FROM long WHERE n >= 1000)"),
            ("values", "fused"),
            ("errors", "(SELECT * FROM long WHERE n < 1000 OR url NOT IN (SELECT url FROM valued))"),
        )
    ),
    "passages",
)
def job5(spark, folder):
    entities = _passages(spark, folder)
    run = jobs.impute_batch(entities, FIELDS, tables.table(spark, folder, "pages"), CONFIG)
    started = dt.datetime(2024, 1, 1, 12)
    logged = jobs.log_tables(run, entities, FIELDS, started, started + dt.timedelta(minutes=5))
    path = jobs.write_log(logged, scratch_dir(spark))
    counts = [
        t.groupBy("run_id").agg(F.count("*").alias("n")).withColumn("log_table", F.lit(name))
        for name, t in jobs.read_log(spark, path, names=log.TABLES).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


@add("job5_logged_values", "SELECT entity_id AS run_id, * EXCLUDE (entity_id) FROM (" + catalog.oracles["job1_impute_batch"] + ")")
def job5_values(spark, folder):
    """What a run has logged as its values, read back from the log."""
    entities = _passages(spark, folder)
    run = jobs.impute_batch(entities, FIELDS, tables.table(spark, folder, "pages"), CONFIG)
    started = dt.datetime(2024, 1, 1, 12)
    logged = jobs.log_tables(run, entities, FIELDS, started, started)
    path = jobs.write_log({log.VALUES: logged[log.VALUES]}, scratch_dir(spark))
    return jobs.read_log(spark, path, names=(log.VALUES,))[log.VALUES].drop("run_date")


@add("job2_impute_stream", catalog.oracles["job1_impute_batch"])
def job2(spark, folder):
    pages = tables.table(spark, folder, "pages")
    arriving = streams.read_stream(spark, f"{folder}/pages.parquet", pages.schema)
    return jobs.impute_stream(_passages(spark, folder), FIELDS, pages, arriving, CONFIG).values


@add(
    "job8_run_summary",
    f"""WITH+ {PICKED}, {EXTRACT_PAGES}, ok AS (SELECT DISTINCT url FROM v WHERE value IS NOT NULL),
        per AS (SELECT entity_id, count(*) AS urls_found, count(*) AS urls_scraped, count(*) FILTER (length(html) < 1000) AS urls_too_small,
                  count(*) FILTER (ok.url IS NOT NULL) AS urls_extracted
                FROM picked JOIN pages ON link = pages.url LEFT JOIN ok ON ok.url = link GROUP BY 1),
        e AS (SELECT entity_id FROM passages UNION ALL SELECT entity_id + 1000000 FROM passages)
        SELECT entity_id, coalesce(urls_found, 0) AS urls_found, coalesce(urls_scraped, 0) AS urls_scraped,
          coalesce(urls_too_small, 0) AS urls_too_small, coalesce(urls_extracted, 0) AS urls_extracted,
          CASE WHEN urls_extracted > 0 THEN 'finished' ELSE 'failed' END AS status,
          CASE WHEN urls_found IS NULL THEN 'SERP failed: No results found' WHEN urls_extracted = 0 THEN 'No successful extractions' END AS error
        FROM e LEFT JOIN per USING (entity_id)""",
    "passages",
)
def job8(spark, folder):
    return _run(spark, folder).runs


def _answers(spark, folder):
    """One vendor answer per distinct part name; some failed, some are short."""
    p = tables.table(spark, folder, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.max("p_size").alias("size"), F.count("*").alias("n")
    )
    n = F.col("n")
    return p.select(
        F.concat(F.lit("https://www.digikey.com/en/products/result?keywords="), "name").alias("url"),
        (n % 5 != 0).alias("success"),
        F.when(n % 3 == 0, F.concat(F.lit('[{"part": "'), "name", F.lit('"}]'))).when(n % 3 == 1, "[]").otherwise(F.repeat("name", F.col("size"))).alias("data"),
        F.when(n % 3 == 2, "html").otherwise("json").alias("data_kind"),
        F.when(n % 5 == 0, "timeout").alias("error"),
    )


ANSWERS = """answers AS (SELECT 'https://www.digikey.com/en/products/result?keywords=' || p_name AS url, p_name AS name, count(*) % 5 <> 0 AS success,
    count(*) % 3 AS kind, length(p_name) * max(p_size) AS size FROM part GROUP BY p_name),
  asked AS (SELECT e.entity_id, a.url, a.success, a.kind, a.success AND (kind = 0 OR (kind = 2 AND size >= 200)) AS usable
    FROM entities e JOIN answers a ON a.name = e.name),
  o AS (SELECT entity_id, bool_or(usable) AS usable, count(*) AS n_results FROM asked GROUP BY 1)"""


@add(
    "job3_fast_path_with_fallback",
    f"""WITH+ {ANSWERS} SELECT e.entity_id, coalesce(usable, false) AS usable, coalesce(n_results, 0) AS n_results, NOT coalesce(usable, false) AS goes_on,
        CASE WHEN coalesce(usable, false) THEN 'finished' ELSE 'running' END AS status,
        CASE WHEN n_results IS NULL THEN 'Fast path failed: No results returned' END AS error
        FROM entities e LEFT JOIN o USING (entity_id) WHERE trim(e.name) <> ''""",
    "entities",
)
def job3(spark, folder):
    config = RunConfig(fast_path=FastPath(mode=MODE_FALLBACK, min_result_size=200))
    return jobs.fast_path(shape(spark, folder, "entities"), _answers(spark, folder), config)


@add(
    "job3_fast_path_only",
    f"""WITH+ {ANSWERS} SELECT e.entity_id, coalesce(usable, false) AS usable, coalesce(n_results, 0) AS n_results, false AS goes_on,
        CASE WHEN n_results IS NULL THEN 'failed' ELSE 'finished' END AS status,
        CASE WHEN n_results IS NULL THEN 'Fast path failed: No results returned' END AS error
        FROM entities e LEFT JOIN o USING (entity_id) WHERE trim(e.name) <> ''""",
    "entities",
)
def job3_only(spark, folder):
    config = RunConfig(fast_path=FastPath(mode=MODE_ONLY, min_result_size=200))
    return jobs.fast_path(shape(spark, folder, "entities"), _answers(spark, folder), config)


VENDOR_FIELDS = [Field("part", "name of the part")]


VENDORS_FIRST = RunConfig(min_page_chars=1000, fast_path=FastPath(mode=MODE_FALLBACK, min_result_size=200))


def _vendors_first(spark, folder):
    config = VENDORS_FIRST
    return jobs.impute_batch(
        shape(spark, folder, "entities"), VENDOR_FIELDS, tables.table(spark, folder, "pages"), config,
        answers=_answers(spark, folder).withColumn("cost", F.lit(0.0025)),
    )


@add(
    "job1_vendors_first",
    f"""WITH+ {ANSWERS} SELECT e.entity_id, 'part' AS field, a.name AS value, 1.0::DOUBLE AS confidence, 1 AS votes, a.url AS source_url
        FROM entities e JOIN answers a ON a.name = e.name WHERE a.success AND a.kind = 0 AND trim(e.name) <> ''""",
    "entities",
)
def job1_vendors(spark, folder):
    return _vendors_first(spark, folder).values


@add(
    "job1_vendor_costs",
    f"""WITH+ {ANSWERS} SELECT e.entity_id, 0.0::DOUBLE AS serp_cost, round(count(a.name) * 0.0025, 6)::DOUBLE AS scrape_cost, 0.0::DOUBLE AS extraction_cost,
          round(count(a.name) * 0.0025, 6)::DOUBLE AS total_cost,
          CASE WHEN count(a.name) FILTER (a.success AND a.kind = 0) = 0 THEN 0.0::DOUBLE
               ELSE round(round(round(count(a.name) * 0.0025, 6) * 1e6) / count(a.name) FILTER (a.success AND a.kind = 0))::DOUBLE / 1e6 END AS cost_per_successful_extraction
        FROM entities e LEFT JOIN answers a ON a.name = e.name AND trim(e.name) <> '' GROUP BY e.entity_id""",
    "entities",
)
def job1_costs(spark, folder):
    return _vendors_first(spark, folder).costs


def _stream_vendors_first(spark, folder):
    pages = tables.table(spark, folder, "pages")
    arriving = streams.read_stream(spark, f"{folder}/pages.parquet", pages.schema)
    answers = _answers(spark, folder).withColumn("cost", F.lit(0.0025))
    return jobs.impute_stream(shape(spark, folder, "entities"), VENDOR_FIELDS, pages, arriving, VENDORS_FIRST, answers)


@add("job2_vendors_first", catalog.oracles["job1_vendors_first"])
def job2_vendors(spark, folder):
    return _stream_vendors_first(spark, folder).values


@add("job2_vendor_costs", catalog.oracles["job1_vendor_costs"])
def job2_costs(spark, folder):
    return _stream_vendors_first(spark, folder).costs


@add(
    "job3_fast_path_errors",
    f"""WITH+ {ANSWERS} SELECT entity_id, url, substr(url, 1, 50) || '...: ' || CASE WHEN NOT success THEN 'timeout' ELSE 'Empty data' END AS reason
        FROM asked WHERE NOT success OR kind = 1""",
    "entities",
)
def job3_errors(spark, folder):
    config = RunConfig(fast_path=FastPath(mode=MODE_ONLY))
    return jobs.fast_path_errors(shape(spark, folder, "entities"), _answers(spark, folder), config)


# low enough that some entities pass it at every size of the tables
BUDGET = RunConfig(min_page_chars=1000, budget_cost=0.03)
MERGED = """dear AS (SELECT entity_id, round(sum(coalesce(cost, 0)), 6) AS total_cost, round(sum(coalesce(cost, 0)), 6) > 0.03 AS budget_mode FROM scrapes GROUP BY 1),
  merged AS (SELECT a.entity_id, a.url, CASE WHEN a.status <> 'ready' AND budget_mode AND b.status = 'ready' THEN 'ready' ELSE a.status END AS status,
      CASE WHEN a.status <> 'ready' AND budget_mode AND b.status = 'ready' THEN b.data ELSE a.data END AS data
    FROM scrapes a JOIN dear USING (entity_id) LEFT JOIN second_scrapes b ON a.entity_id = b.entity_id AND a.url = b.url)"""
BUDGET_EXTRACT = f"""{MERGED}, body AS (SELECT entity_id, url, data AS raw, CASE WHEN length(data) > 10000 THEN {REDUCED.format('data')} ELSE data END AS data
    FROM merged WHERE status = 'ready' AND length(data) >= 1000),
  {blocks_sql('body', 'data')}, {flags_sql(WORDS)},
  f AS (SELECT b.*, coalesce(k.filtered, '') AS filtered FROM body b
        LEFT JOIN (SELECT url, {filtered_sql('contextual')} AS filtered FROM flags GROUP BY url) k USING (url)),
  v AS (SELECT * FROM {long_rows('f', 'filtered', 'raw')})"""


def _budget(spark, folder):
    return jobs.flow_with_budget(shape(spark, folder, "scrapes"), shape(spark, folder, "second_scrapes"), FIELDS, BUDGET)


@add(
    "job4_budget_runs",
    f"""WITH+ {BUDGET_EXTRACT}, ok AS (SELECT DISTINCT url FROM v WHERE value IS NOT NULL)
        SELECT entity_id, total_cost, budget_mode, count(*) FILTER (status = 'ready') AS successful_scrapes,
          count(*) FILTER (status = 'ready' AND coalesce(length(data), 0) < 1000) AS scrapes_too_small, count(ok.url) AS successful_extractions,
          CASE WHEN count(ok.url) > 0 THEN 'finished' ELSE 'failed' END AS status,
          CASE WHEN count(*) FILTER (status = 'ready') = 0 THEN 'No successful scrapes' WHEN count(ok.url) = 0 THEN 'No successful extractions' END AS error
        FROM merged JOIN dear USING (entity_id) LEFT JOIN ok USING (url) GROUP BY 1, 2, 3""",
    "scrapes second_scrapes",
)
def job4(spark, folder):
    return _budget(spark, folder)[0]


@add(
    "job4_budget_values",
    f"""WITH+ {BUDGET_EXTRACT}, {CONFIDENT.format(links='merged')} {FUSED.format(good='good')}
        SELECT entity_id, field, value, confidence, votes, source_url FROM fused""",
    "scrapes second_scrapes",
)
def job4_values(spark, folder):
    return _budget(spark, folder)[1]


@add(
    "job6_profile_run",
    f"""SELECT s.*, CASE WHEN max > t THEN t END AS threshold,
        CASE WHEN max > t THEN CASE WHEN max > t * CASE WHEN t = 10 THEN 3 ELSE 5 END THEN 'high' ELSE 'medium' END END AS concern_level,
        CASE WHEN max > t THEN r END AS recommendation FROM {PHASE_STATS} s LEFT JOIN (VALUES
          ('request_to_snapshot', 10.0::DOUBLE, 'Pages come in slowly: raise the number of parallel fetches or shorten their timeout'),
          ('snapshot_to_poll', 10.0, 'Pages come in slowly: raise the number of parallel fetches or shorten their timeout'),
          ('poll_to_data', 10.0, 'Pages come in slowly: raise the number of parallel fetches or shorten their timeout'),
          ('total_scrape_time', 10.0, 'Pages come in slowly: raise the number of parallel fetches or shorten their timeout'),
          ('parse_converttodict_duration', 0.1, 'Converting answers takes long: move it off the thread that waits for them'),
          ('filter_enqueue_to_dequeue', 1.0, 'Calls wait in the queue: allow the model service more calls at once'),
          ('parse_enqueue_to_dequeue', 1.0, 'Calls wait in the queue: allow the model service more calls at once'),
          ('filter_to_parse_gap', 0.1, NULL)) l(phase, t, r) ON l.phase = s.phase""".replace("SELECT s.*,", "SELECT s.phase, n, min, max, avg, std,"),
)
def job6(spark, folder):
    return jobs.profile_run(stage_times(spark, folder))


@add(
    "job7_compare_strategies",
    f"""{SCORED} SELECT strategy, round(avg(score), 4) AS score, dense_rank() OVER (ORDER BY round(avg(score), 4) DESC) AS rank
        FROM scored GROUP BY strategy""",
)
def job7(spark, folder):
    pages = tables.table(spark, folder, "pages")
    ranked = jobs.compare_strategies(pages, LABEL_WORDS, FIELDS)
    return ranked.select("strategy", "score", "rank")
