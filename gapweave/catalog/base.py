"""Registering queries and the SQL that checks them.

The input shapes (entities, scrapes, hits, run events …) are derived from the
given tables by SQL that both engines read the same way; the operators and the
checking SQL are written separately.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..sources import tables

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# --- input shapes, valid in Spark SQL and in the checking SQL -----------------

SHAPES = {
    # components to research; one in fifty has a blank name
    "entities": """
        SELECT p_partkey AS entity_id,
               CASE WHEN p_partkey % 50 = 0 THEN '  ' ELSE p_name END AS name,
               CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN ''
                    ELSE p_brand END AS identifier_context,
               CASE WHEN p_size % 2 = 0 THEN p_type END AS impute_task_purpose
        FROM {part}""",
    # passages to look up in a corpus
    "passages": "SELECT item_id AS entity_id, text AS name FROM {benchmark}",
    # as many entities as there are pages, named by their titles
    "titles": """
        SELECT page_id AS entity_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS name FROM {pages}""",
    # links with every defect the validation knows
    "links": """
        SELECT page_id,
               CASE WHEN page_id % 13 = 0 THEN NULL
                    WHEN page_id % 13 = 1 THEN ' ' || url || ' '
                    WHEN page_id % 13 = 2 THEN upper(url)
                    WHEN page_id % 13 = 3 THEN 'ftp://files.example.org/' || page_id
                    WHEN page_id % 13 = 4 THEN url || '&via=Facebook.com'
                    WHEN page_id % 13 = 5 THEN 'https://www.Reddit.com/r/' || page_id
                    WHEN page_id % 13 = 6 THEN 'https://a.example.com/f' || page_id || '.PDF?x=1'
                    WHEN page_id % 13 = 7 THEN 'https://example.pdf'
                    WHEN page_id % 13 = 8 THEN 'invalid-url'
                    WHEN page_id % 13 = 9 THEN 'https://a.example.com/sheet.xlsx#s' || page_id
                    ELSE url END AS url
        FROM {pages}""",
    # fetched pages: some failed, some empty, some without a cost
    "scrapes": """
        SELECT page_id % 20 AS entity_id, page_id, url,
               CASE WHEN page_id % 11 = 0 THEN 'failed' ELSE 'ready' END AS status,
               page_id % 11 <> 0 AS success,
               CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN ''
                    ELSE html END AS data,
               'html' AS data_kind,
               CASE WHEN page_id % 17 = 0 THEN NULL
                    ELSE round(CAST(length(html) AS DOUBLE) / 1000000, 6) END AS cost,
               CASE WHEN page_id % 22 = 0 THEN 'timeout' END AS error,
               page_id % 2 = 0 AS fallback_used
        FROM {pages}""",
    # a second attempt; some of its links were not in the first one
    "second_scrapes": """
        SELECT page_id % 20 AS entity_id, page_id,
               CASE WHEN page_id % 7 = 3 THEN url || '#retry' ELSE url END AS url,
               CASE WHEN page_id % 22 = 0 OR page_id % 5 = 0 THEN 'ready' ELSE 'failed' END AS status,
               page_id % 22 = 0 OR page_id % 5 = 0 AS success,
               CASE WHEN page_id % 22 = 0 OR page_id % 5 = 0 THEN html END AS data,
               'html' AS data_kind,
               CAST(0.001 AS DOUBLE) AS cost,
               CASE WHEN NOT (page_id % 22 = 0 OR page_id % 5 = 0) THEN 'blocked' END AS error,
               FALSE AS fallback_used
        FROM {pages}""",
    # run log: one row per stage event
    "run_events": """
        SELECT user_id AS run_id, event_id,
               'https://runs.example.org/' || event_id AS url,
               CASE WHEN event_type = 'signup' THEN 'found'
                    WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'scraping'
                    WHEN event_type = 'view' THEN 'extracting'
                    WHEN event_type = 'click' THEN 'scraped'
                    WHEN event_type = 'purchase' THEN 'extracted'
                    ELSE 'failed' END AS stage,
               round(value / 100, 4) AS cost, ts
        FROM {events}""",
    # search hits of two channels; some links are not in the page store
    "hits": """
        SELECT page_id % 20 AS entity_id, 'google_api' AS channel, 0 AS channel_order,
               CAST(floor(page_id / 20) AS BIGINT) + 1 AS channel_rank, url AS link,
               'page ' || page_id AS title
        FROM {pages}
        UNION ALL
        SELECT page_id % 20, 'serpapi', 1,
               CASE WHEN CAST(floor(page_id / 20) AS BIGINT) % 2 = 0
                    THEN CAST(floor(page_id / 20) AS BIGINT) + 2
                    ELSE CAST(floor(page_id / 20) AS BIGINT) END,
               CASE WHEN page_id % 19 = 0 THEN url || '/gone' ELSE url END,
               'page ' || page_id
        FROM {pages}""",
    "channel_usage": """
        SELECT page_id % 20 AS entity_id,
               CASE WHEN page_id % 2 = 0 THEN 'google_api' ELSE 'serpapi' END AS channel,
               CAST(0.005 AS DOUBLE) AS cost,
               CAST(length(html) AS DOUBLE) / 1000 AS elapsed
        FROM {pages}""",
    # extracted values in long form, nulls kept
    "values": """
        SELECT entity_id, field, doc_id, CASE WHEN field = 'lang' THEN lang ELSE quality END AS value, confidence
        FROM (SELECT d.source AS entity_id, d.doc_id, d.lang, CAST(l.quality AS STRING) AS quality,
                     (d.n_chars % 100) / CAST(100 AS DOUBLE) AS confidence, EACH('lang', 'quality') AS field
              FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) x""",
    # a table with gaps
    "gaps": """
        SELECT d.doc_id, d.source AS entity_id,
               CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.lang END AS lang,
               CAST(l.quality AS STRING) AS quality
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # JSON of every shape, with broken and fenced texts
    "contents": """
        SELECT event_id, user_id AS entity_id,
               CASE event_id % 12
                    WHEN 0 THEN props
                    WHEN 1 THEN '[' || props || ',{{"k": 2, "v": "' || event_type || '"}}]'
                    WHEN 2 THEN '[]'
                    WHEN 3 THEN '[1, "x", ' || props || ']'
                    WHEN 4 THEN '"' || event_type || '"'
                    WHEN 5 THEN CAST(event_id AS STRING)
                    WHEN 6 THEN 'null'
                    WHEN 7 THEN '{{"k": ' || event_type
                    WHEN 8 THEN NULL
                    WHEN 9 THEN '```json' || chr(10) || props || chr(10) || '```'
                    WHEN 10 THEN '{{}}'
                    ELSE '{{"k": "' || event_type || '", "n": {{"a": 1}}, "z": null}}' END AS j,
               CASE WHEN event_id % 12 IN (9, 7) THEN 'html' ELSE 'json' END AS data_kind,
               event_id % 5 <> 0 AS success
        FROM {events}""",
    # usage and token counts of one extraction each
    "usages": """
        SELECT event_id, user_id AS run_id, value,
               CASE WHEN event_id % 4 = 0 THEN value / 100 END AS total_cost,
               CASE WHEN event_id % 4 IN (0, 1) THEN value / 200 END AS cost,
               event_id % 4 = 3 AS no_usage,
               CASE WHEN event_id % 9 = 0 THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS filter_in,
               CAST(floor(value * 4) AS BIGINT) AS filter_out,
               CAST(floor(value * 3) AS BIGINT) AS parse_out
        FROM {events}""",
}


# shapes whose rows take long to work on, so that every core should get some
HEAVY_SHAPES = ("contents",)


def shape(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived input as a DataFrame."""
    text = re.sub(r"EACH\((.*?)\)", r"explode(array(\1))", SHAPES[name])
    used = {t: tables.table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text, **used)
    return tables.spread(df) if name in HEAVY_SHAPES else df


def shape_sql(name: str) -> str:
    text = re.sub(r"EACH\((.*?)\)", r"unnest([\1])", SHAPES[name])
    return text.format(**{t: t for t in TABLES})


def with_shapes(names: str, query: str) -> str:
    """``query`` preceded by the named inputs as common table expressions."""
    parts = ", ".join(f'"{n}" AS ({shape_sql(n)})' for n in names.split())
    joiner = ", " if query.lstrip().startswith("WITH+") else " "
    return f"WITH {parts}{joiner}{query.lstrip().removeprefix('WITH+')}"


class Catalog:
    """Queries of one area with their checking SQL."""

    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def add(self, name: str, sql: str | None = None, shapes: str = ""):
        """Register the decorated ``(spark, folder) -> DataFrame``."""

        def register(fn):
            def run(spark, folder):
                return fn(session.prepare(spark), folder)

            run.__name__ = name
            run.__doc__ = fn.__doc__
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = with_shapes(shapes, sql) if shapes else sql
            return fn

        return register


def stage_times(spark: SparkSession, folder: str) -> DataFrame:
    """Instants of one fetch and extraction per event, spread by its value.

    Events of type ``error`` were fetched but never extracted.
    """
    events = tables.table(spark, folder, "events")
    t0 = F.unix_micros(F.col("ts").cast("timestamp"))
    step = F.round(F.col("value") * 100).cast("long") * 1000

    def at(n):
        return F.timestamp_micros(t0 + step * n)

    def if_extracted(col):
        return F.when(F.col("event_type") != "error", col)

    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").cast("string").alias("url"),
        at(0).alias("request_sent"),
        at(1).alias("snapshot_received"),
        at(2).alias("snapshot_polled"),
        at(4).alias("data_received"),
        if_extracted(at(5)).alias("filter_requested"),
        if_extracted(at(6)).alias("filter_enqueued"),
        if_extracted(at(8)).alias("filter_dequeued"),
        if_extracted(at(11)).alias("filter_completed"),
        if_extracted(at(12)).alias("parse_requested"),
        if_extracted(at(13)).alias("parse_enqueued"),
        if_extracted(at(15)).alias("parse_dequeued"),
        if_extracted(at(16)).alias("convert_start"),
        if_extracted(at(17)).alias("convert_end"),
        if_extracted(at(20)).alias("parse_completed"),
    )


# the same instants as whole microseconds, for the checking SQL
STAGE_TIMES_SQL = """(SELECT user_id AS run_id, CAST(event_id AS VARCHAR) AS url, event_type <> 'error' AS extracted,
    epoch_us(ts) AS t0, CAST(round(value * 100) AS BIGINT) * 1000 AS step FROM events)"""
