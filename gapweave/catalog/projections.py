"""Projections, filters and predicates (P), entity and schema sources (S1–S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import content, html, urls, usage
from ..operators import fetch, metrics
from ..sources import tables
from .base import Catalog, shape

catalog = Catalog()
add = catalog.add

TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
BLOCKED = "facebook\\.com|twitter\\.com|instagram\\.com|tiktok\\.com|youtube\\.com|pinterest\\.com|reddit\\.com"
VALID = f"""coalesce(regexp_matches({TRIM.format('url')}, '^https?://')
    AND NOT regexp_matches(lower({TRIM.format('url')}), '{BLOCKED}'), false)"""

NOISE = r"""regexp_replace(regexp_replace({}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
    '(?s)<!--.*?-->', ' ', 'g')"""
REDUCED = (
    r"trim(regexp_replace(regexp_replace(" + NOISE
    + r", '(?s)<([a-zA-Z][a-zA-Z0-9]*)\s[^>]*>', '<\1>', 'g'), '\s+', ' ', 'g'))"
)
TEXT = (
    r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(" + NOISE
    + r""", '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'),
    '\s+', ' ', 'g'))"""
)


@add(
    "s1_entity_source",
    """SELECT entity_id, name, identifier_context, impute_task_purpose, 'object' AS given_as FROM entities
       UNION ALL SELECT p_partkey, p_name, NULL, NULL, 'string' FROM part""",
    "entities",
)
def s1(spark, folder):
    objects = shape(spark, folder, "entities").withColumn("given_as", F.lit("object"))
    strings = tables.entities_from_names(tables.table(spark, folder, "part"), "p_partkey", "p_name")
    return objects.unionByName(strings.withColumn("given_as", F.lit("string")))


def _field_sets(spark, folder):
    """Each part as a schema of three wanted fields; some have blank names."""
    return tables.table(spark, folder, "part").select(
        F.col("p_partkey").alias("schema_id"),
        F.array(
            F.struct(
                F.col("p_type").alias("name"),
                F.concat(F.lit("kind of "), "p_name").alias("desc"),
                F.col("p_brand").alias("example"),
            ),
            F.struct(
                F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.lit("price")).alias("name"),
                F.lit("retail price").alias("desc"),
                F.lit(None).cast("string").alias("example"),
            ),
            F.struct(
                F.col("p_brand").alias("name"),
                F.when(F.col("p_size") % 7 == 0, "").otherwise(F.lit("brand")).alias("desc"),
                F.col("p_name").alias("example"),
            ),
        ).alias("fields"),
    )


FIELD_SETS = """(SELECT p_partkey AS schema_id, 0 AS pos, p_type AS name, 'kind of ' || p_name AS "desc", p_brand AS example FROM part
  UNION ALL SELECT p_partkey, 1, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE 'price' END, 'retail price', NULL FROM part
  UNION ALL SELECT p_partkey, 2, p_brand, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'brand' END, p_name FROM part)"""


@add("s2_schema_fields", f"""SELECT * FROM {FIELD_SETS} WHERE trim(name) <> '' AND trim("desc") <> ''""")
def s2(spark, folder):
    return tables.schema_field_rows(_field_sets(spark, folder))


@add(
    "s3_page_source",
    "SELECT page_id, url, length(html) AS n_chars, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages",
)
def s3(spark, folder):
    pages = tables.table(spark, folder, "pages")
    return pages.select("page_id", "url", F.length("html").alias("n_chars"), urls.host(F.col("url")).alias("host"))


@add(
    "p1_build_query",
    """SELECT entity_id, concat_ws(' ', name, nullif(identifier_context, ''), nullif(impute_task_purpose, '')) AS query
       FROM entities""",
    "entities",
)
def p1(spark, folder):
    e = shape(spark, folder, "entities")
    return e.select(
        "entity_id",
        urls.build_query(F.col("name"), F.col("identifier_context"), F.col("impute_task_purpose")).alias("query"),
    )


@add("p2_valid_entities", "SELECT * FROM entities WHERE trim(name) <> ''", "entities")
def p2(spark, folder):
    return tables.valid_entities(shape(spark, folder, "entities"))


@add(
    "p3_valid_urls",
    f"""SELECT page_id, url, {VALID} AS is_valid,
        {VALID} OR coalesce(regexp_matches({TRIM.format('url')}, '^https?://') AND NOT
          regexp_matches(lower(regexp_extract({TRIM.format('url')}, '^https?://([^/?#]+)', 1)),
                         '(^|\\.)({BLOCKED})$'), false) AS is_valid_by_host
        FROM links""",
    "links",
)
def p3(spark, folder):
    links = shape(spark, folder, "links")
    return links.select(
        "page_id",
        "url",
        urls.is_valid_url(F.col("url")).alias("is_valid"),
        urls.is_valid_url(F.col("url"), match_host=True).alias("is_valid_by_host"),
    )


@add(
    "p4_file_links",
    r"""SELECT page_id, url, coalesce(regexp_matches(regexp_replace(url, '[?#].*$', ''),
        '(?i)\.(pdf|docx?|xlsx?|pptx?|zip)$'), false) AS is_file FROM links""",
    "links",
)
def p4(spark, folder):
    links = shape(spark, folder, "links")
    return links.select("page_id", "url", urls.is_file_link(F.col("url")).alias("is_file"))


@add("p5_ready", "SELECT entity_id, url, status FROM scrapes WHERE status = 'ready'", "scrapes")
def p5(spark, folder):
    return fetch.ready(shape(spark, folder, "scrapes")).select("entity_id", "url", "status")


@add(
    "p6_extractable",
    "SELECT entity_id, url, length(data) AS n_chars FROM scrapes WHERE status = 'ready' AND length(data) > 0",
    "scrapes",
)
def p6(spark, folder):
    rows = fetch.extractable(shape(spark, folder, "scrapes"))
    return rows.select("entity_id", "url", F.length("data").alias("n_chars"))


JSON_SIZE = "CASE WHEN data_kind = 'html' OR NOT json_valid(j) THEN length(j) ELSE length(CAST(json(j) AS VARCHAR)) END"


@add(
    "p7_content_size",
    f"""SELECT 'page' AS origin, page_id AS id, coalesce(length(data), 0) AS size FROM scrapes
        UNION ALL SELECT 'json', event_id, coalesce({JSON_SIZE}, 0) FROM contents""",
    "scrapes contents",
)
def p7(spark, folder):
    pages = shape(spark, folder, "scrapes").select(
        F.lit("page").alias("origin"),
        F.col("page_id").alias("id"),
        content.content_size(F.col("data"), F.col("data_kind")).alias("size"),
    )
    answers = shape(spark, folder, "contents").select(
        F.lit("json").alias("origin"),
        F.col("event_id").alias("id"),
        content.content_size(F.col("j"), F.col("data_kind")).alias("size"),
    )
    return pages.unionByName(answers)


@add(
    "p8_size_gate",
    """SELECT entity_id, url, length(data) AS n_chars, length(data) >= 1000 AS passed,
       CASE WHEN length(data) < 1000 THEN 'Scrape for ' || substr(url, 1, 40) || '... too small: '
            || length(data) || ' chars' END AS error
       FROM scrapes WHERE status = 'ready' AND length(data) > 0""",
    "scrapes",
)
def p8(spark, folder):
    gated = fetch.size_gate(fetch.extractable(shape(spark, folder, "scrapes")), 1000)
    return gated.select("entity_id", "url", "n_chars", "passed", F.col("gate_error").alias("error"))


FAST_SIZE = """CASE WHEN data_kind = 'html' THEN length(j) WHEN NOT json_valid(j) THEN length(j)
    WHEN json_type(j) = 'ARRAY' THEN 1000 * json_array_length(j) ELSE length(CAST(json(j) AS VARCHAR)) END"""
USABLE = """coalesce(success AND CASE WHEN data_kind = 'html' THEN length(j) >= {}
    WHEN NOT json_valid(j) THEN length(j) > 0
    WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) > 0
    WHEN json_type(j) = 'OBJECT' THEN len(json_keys(j)) > 0
    WHEN json_type(j) = 'NULL' THEN false ELSE length(j) > 0 END, false)"""


@add("p9_fast_path_size", f"SELECT event_id, coalesce({FAST_SIZE}, 0)::BIGINT AS size FROM contents", "contents")
def p9(spark, folder):
    c = shape(spark, folder, "contents")
    return c.select("event_id", content.fast_path_size(F.col("j"), F.col("data_kind")).alias("size"))


@add(
    "p10_fast_path_usable",
    f"SELECT entity_id, bool_or({USABLE.format(20)}) AS usable, count(*) AS n_results FROM contents GROUP BY 1",
    "contents",
)
def p10(spark, folder):
    c = shape(spark, folder, "contents").withColumnRenamed("j", "data")
    return fetch.fast_path_outcome(c, min_size=20).select("entity_id", "usable", "n_results")


@add(
    "p11_fast_path_urls",
    """SELECT entity_id, d.domain, d.base || name AS url FROM entities,
       (VALUES ('digikey', 'https://www.digikey.com/en/products/result?keywords='),
               ('mouser', 'https://www.mouser.com/Search/Refine?Keyword=')) d(domain, base)
       WHERE trim(name) <> ''""",
    "entities",
)
def p11(spark, folder):
    e = tables.valid_entities(shape(spark, folder, "entities"))
    return fetch.fast_path_requests(e, ("digikey", "mouser")).select("entity_id", "domain", "url")


@add(
    "p12_trim",
    """SELECT url, md5(substr(data, 1, 3000)) AS digest, CASE WHEN length(data) > 3000 THEN 3000 END AS trimmed_to
       FROM scrapes""",
    "scrapes",
)
def p12(spark, folder):
    s = fetch.trim_long(shape(spark, folder, "scrapes"), 3000)
    return s.select("url", F.md5("data").alias("digest"), "trimmed_to")


@add(
    "p13_reduce_decision",
    f"""SELECT url, length(data) > 10000 AS reduced,
        length(CASE WHEN length(data) > 10000 THEN {REDUCED.format('data')} ELSE data END) AS n_chars
        FROM scrapes WHERE length(data) > 0""",
    "scrapes",
)
def p13(spark, folder):
    s = shape(spark, folder, "scrapes").filter(F.length("data") > 0)
    done = fetch.reduce_long(s, config.REDUCE_ABOVE_CHARS)
    return done.select("url", "reduced", F.length("data").alias("n_chars"))


@add(
    "p14_reduce_html",
    f"""SELECT url, md5(r) AS digest, length(r) AS n_chars,
        round((1 - length(r) / CAST(length(html) AS DOUBLE)) * 100, 4) AS reduction_percent
        FROM (SELECT url, html, {REDUCED.format('html')} AS r FROM pages)""",
)
def p14(spark, folder):
    p = tables.table(spark, folder, "pages").withColumn("r", html.reduce_html(F.col("html")))
    return p.select(
        "url",
        F.md5("r").alias("digest"),
        F.length("r").alias("n_chars"),
        html.reduction_percent(F.col("html"), F.col("r")).alias("reduction_percent"),
    )


@add("p15_html_text", f"SELECT url, md5(t) AS digest, length(t) AS n_chars FROM (SELECT url, {TEXT.format('html')} AS t FROM pages)")
def p15(spark, folder):
    p = tables.table(spark, folder, "pages").withColumn("t", html.html_to_text(F.col("html")))
    return p.select("url", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


@add("p16_convert_fields", f'SELECT schema_id, pos, name || \'|\' || "desc" || \'|\' || coalesce(example, \'\') AS spec FROM {FIELD_SETS}')
def p16(spark, folder):
    sets = _field_sets(spark, folder).select("schema_id", tables.convert_fields("fields").alias("fields"))
    rows = sets.select("schema_id", F.posexplode("fields").alias("pos", "f"))
    spec = F.concat("f.name", F.lit("|"), "f.desc", F.lit("|"), F.coalesce("f.example", F.lit("")))
    return rows.select("schema_id", "pos", spec.alias("spec"))


@add(
    "p17_scrape_summary",
    """SELECT entity_id, url, success, status, cost, error, fallback_used,
       regexp_extract(url, '^https?://([^/?#]+)', 1) AS root_domain,
       CASE WHEN data IS NULL THEN 'none' ELSE data_kind END AS data_type, coalesce(length(data), 0) AS data_size
       FROM scrapes""",
    "scrapes",
)
def p17(spark, folder):
    return fetch.scrape_summary(shape(spark, folder, "scrapes"))


COUNTERS = """(SELECT run_id,
    greatest(0, count(*) FILTER (stage = 'scraping') - count(*) FILTER (stage = 'scraped')) AS urls_scraping,
    count(*) FILTER (stage = 'scraped') AS urls_scraped,
    greatest(0, count(*) FILTER (stage = 'extracting') - count(*) FILTER (stage = 'extracted')) AS urls_extracting,
    count(*) FILTER (stage = 'extracted') AS urls_extracted,
    count(*) FILTER (stage = 'failed') AS urls_failed,
    count(*) FILTER (stage = 'found') AS urls_found,
    CASE run_id % 6 WHEN 0 THEN 'initializing' WHEN 1 THEN 'finished' WHEN 2 THEN 'failed'
         WHEN 3 THEN 'cancelled' WHEN 4 THEN 'running' ELSE 'paused' END AS status,
    run_id % 8 <> 4 AS serp_completed,
    (sum(CAST(round(cost * 1000000) AS BIGINT))::BIGINT + 500) // 1000 AS thousandths,
    (epoch_us(max(ts)) - epoch_us(min(ts)) + 50000) // 100000 AS tenths
  FROM run_events GROUP BY run_id)"""
STATUS = """CASE WHEN status = 'initializing' THEN 'Initializing pipeline...'
    WHEN status = 'running' AND NOT serp_completed THEN 'Searching for URLs...'
    WHEN status = 'running' THEN
      CASE WHEN urls_scraping + urls_extracting > 0 THEN concat_ws(', ',
             CASE WHEN urls_scraping > 0 THEN urls_scraping || ' scraping' END,
             CASE WHEN urls_extracting > 0 THEN urls_extracting || ' extracting' END)
           ELSE 'Processing...' END || ' | ' || urls_extracted || ' extracted'
      || CASE WHEN urls_failed > 0 THEN ', ' || urls_failed || ' failed' ELSE '' END || ' of ' || urls_found
    WHEN status = 'finished' THEN 'Finished: ' || urls_extracted || '/' || urls_found || ' successful extractions'
    WHEN status = 'failed' THEN 'Failed: ' || urls_extracted || '/' || urls_found || ' completed, ' || urls_failed || ' errors'
    WHEN status = 'cancelled' THEN 'Cancelled: ' || urls_extracted || '/' || urls_found || ' completed before cancellation'
    ELSE 'Status: ' || status END"""


def _run_states(spark, folder):
    """Counters per run with a state of every kind."""
    states = ["initializing", "finished", "failed", "cancelled", "running", "paused"]
    counters = metrics.stage_counters(shape(spark, folder, "run_events"))
    picked = F.get(F.array(*[F.lit(s) for s in states]), (F.col("run_id") % 6).cast("int"))
    return counters.withColumn("status", picked).withColumn("serp_completed", F.col("run_id") % 8 != 4)


@add("p18_status_text", f"SELECT run_id, {STATUS} AS status_text FROM {COUNTERS}", "run_events")
def p18(spark, folder):
    return metrics.with_status_text(_run_states(spark, folder)).select("run_id", "status_text")


@add(
    "p19_live_summary",
    f"""SELECT run_id, 'run ' || run_id || ' | ' || {STATUS} || ' | ' || (tenths // 10) || '.' || (tenths % 10)
        || 's | $' || (thousandths // 1000) || '.' || lpad((thousandths % 1000)::VARCHAR, 3, '0') AS summary FROM {COUNTERS}""",
    "run_events",
)
def p19(spark, folder):
    r = metrics.with_status_text(_run_states(spark, folder))
    line = usage.live_summary(
        F.concat(F.lit("run "), F.col("run_id").cast("string")),
        F.col("status_text"),
        F.col("seconds"),
        F.round("total_cost", 6),
    )
    return r.select("run_id", line.alias("summary"))


def _stages(spark, folder):
    u = shape(spark, folder, "usages")

    def stage(name, tokens_in, tokens_out):
        return F.struct(F.lit(name).alias("stage"), F.col(tokens_in).alias("input"), F.col(tokens_out).alias("output"))

    return u.withColumn("stages", F.array(stage("filter", "filter_in", "filter_out"), stage("parse", "filter_out", "parse_out")))


REDUCTION = "coalesce(round(({0} - {1}) / nullif(CAST({0} AS DOUBLE), 0) * 100, 6), 0)"


@add(
    "p20_token_reduction",
    f"""SELECT event_id, {REDUCTION.format('filter_in', 'filter_out')} AS filter_reduction,
        {REDUCTION.format('filter_out', 'parse_out')} AS parse_reduction,
        {REDUCTION.format('filter_in', 'parse_out')} AS overall_reduction FROM usages""",
    "usages",
)
def p20(spark, folder):
    s = _stages(spark, folder)

    def reduction(i):
        at = F.col("stages")[i]
        return F.round(usage.token_reduction(at["input"], at["output"]), 6)

    return s.select(
        "event_id",
        reduction(0).alias("filter_reduction"),
        reduction(1).alias("parse_reduction"),
        F.round(usage.overall_reduction(F.col("stages")), 6).alias("overall_reduction"),
    )


def usage_maps(df):
    """Usage as a map that holds only the known keys, null where unknown."""
    both = F.create_map(F.lit("total_cost"), F.col("total_cost"), F.lit("cost"), F.col("cost"))
    return df.withColumn("usage", F.when(~F.col("no_usage"), F.map_filter(both, lambda _, v: v.isNotNull())))


@add("p21_extract_cost", "SELECT event_id, coalesce(CASE WHEN NOT no_usage THEN coalesce(total_cost, cost) END, 0) AS cost FROM usages", "usages")
def p21(spark, folder):
    u = usage_maps(shape(spark, folder, "usages"))
    return u.select("event_id", usage.extract_cost(F.col("usage")).alias("cost"))


NORMALISED = """(
    SELECT event_id, k AS key, json_extract_string(j, '$."' || k || '"') AS value
      FROM (SELECT event_id, j, unnest(json_keys(j)) AS k FROM src WHERE json_type(j) = 'OBJECT')
    UNION ALL
    SELECT event_id, key, arg_max(value, i) FROM (
      SELECT event_id, i, unnest(json_keys(x)) AS key, x FROM (
        SELECT event_id, unnest(range(json_array_length(j)::BIGINT)) AS i, json_extract(j, '$[' || i || ']') AS x FROM lists WHERE objects)
      ), LATERAL (SELECT json_extract_string(x, '$."' || key || '"') AS value) GROUP BY event_id, key
    UNION ALL
    SELECT event_id, 'item_' || i, json_extract_string(j, '$[' || i || ']')
      FROM (SELECT event_id, j, unnest(range(json_array_length(j)::BIGINT)) AS i FROM lists WHERE NOT objects)
    UNION ALL
    SELECT event_id, 'value', json_extract_string(j, '$') FROM src
      WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL'))"""
LISTS = """lists AS (SELECT event_id, j, list_bool_and(list_transform(json_extract(j, '$[*]'), lambda x: json_type(x) = 'OBJECT')) AS objects
     FROM src WHERE json_type(j) = 'ARRAY')"""


@add(
    "p22_normalise_content",
    f"""WITH+ src AS (SELECT event_id, j FROM contents WHERE json_valid(j)), {LISTS}
        SELECT event_id, key, value FROM {NORMALISED}""",
    "contents",
)
def p22(spark, folder):
    c = shape(spark, folder, "contents")
    return c.select("event_id", F.explode(content.normalise(F.col("j"))))


REASON = """CASE WHEN NOT success THEN substr(url, 1, 50) || '...: ' || coalesce(error, 'Unknown error')
    WHEN data IS NULL OR data = '' THEN substr(url, 1, 50) || '...: No data returned' END"""


@add(
    "p23_failure_reasons",
    f"""SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY url, reason) AS nr, reason AS text
        FROM (SELECT entity_id, url, {REASON} AS reason FROM scrapes) WHERE reason IS NOT NULL""",
    "scrapes",
)
def p23(spark, folder):
    reasons = fetch.failure_reasons(shape(spark, folder, "scrapes"))
    return fetch.numbered_texts(reasons, ["entity_id"], "url", "reason")


@add(
    "p24_failed_extracts",
    """SELECT s.entity_id, s.url, coalesce(x.ok, false) AS success,
       CASE WHEN x.ok IS NULL THEN 'Extraction returned nothing' END AS error
       FROM scrapes s LEFT JOIN (SELECT url, true AS ok FROM scrapes WHERE status = 'ready' AND length(data) >= 1000) x USING (url)
       WHERE s.status = 'ready' AND length(s.data) > 0""",
    "scrapes",
)
def p24(spark, folder):
    s = shape(spark, folder, "scrapes")
    asked = fetch.extractable(s)
    answered = fetch.size_gate(asked, 1000).filter("passed").select(
        "entity_id", "url", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error")
    )
    return fetch.with_failed_rows(asked.select("entity_id", "url"), answered)


@add(
    "p25_high_cost",
    "SELECT run_id, round(sum(cost), 6) AS total_cost, round(sum(cost), 6) > 10 AS is_high FROM run_events GROUP BY run_id",
    "run_events",
)
def p25(spark, folder):
    total = shape(spark, folder, "run_events").groupBy("run_id").agg(F.round(usage.exact_sum(F.col("cost")), 6).alias("total_cost"))
    return total.withColumn("is_high", usage.is_high_cost(F.col("total_cost")))
