"""Streams (X) run to the end of the given tables and read back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import lifetime, log
from ..session import scratch_dir
from ..sources import tables
from ..streaming import streams
from .base import SHAPES, Catalog
from .extraction import EXTRACTED, FIELDS, TOKENS

catalog = Catalog()
add = catalog.add

CONFIG = RunConfig(min_page_chars=1000)


def stream_shape(spark, folder, name):
    """A derived input over a stream of its table."""
    (table,) = set(re.findall(r"\{(\w+)\}", SHAPES[name]))
    schema = tables.table(spark, folder, table).schema
    return spark.sql(SHAPES[name], **{table: streams.read_stream(spark, f"{folder}/{table}.parquet", schema)})


@add(
    "x1_extract_stream",
    f"""WITH+ {EXTRACTED} SELECT entity_id, url, n_values > 0 AS success, length(filtered) AS filtered_chars, title, {TOKENS.format("coalesce(txt, '')")} AS tokens_out
        FROM f JOIN per USING (url) JOIN (SELECT url FROM scrapes WHERE length(data) >= 1000) USING (url)""",
    "scrapes",
)
def x1(spark, folder):
    path = scratch_dir(spark)
    out = streams.extract_stream(stream_shape(spark, folder, "scrapes"), FIELDS, CONFIG)
    streams.append_files(out, path)
    done = spark.read.parquet(path)
    return done.select(
        "entity_id", "url", "success", "filtered_chars", F.col("content")["title"][0].alias("title"),
        F.col("stage_tokens")[1]["output"].alias("tokens_out"),
    )


@add(
    "x2_live_counters",
    """SELECT run_id, greatest(0, count(*) FILTER (stage = 'scraping') - count(*) FILTER (stage = 'scraped')) AS urls_scraping,
       count(*) FILTER (stage = 'scraped') AS urls_scraped,
       greatest(0, count(*) FILTER (stage = 'extracting') - count(*) FILTER (stage = 'extracted')) AS urls_extracting,
       count(*) FILTER (stage = 'extracted') AS urls_extracted, count(*) FILTER (stage = 'failed') AS urls_failed,
       count(*) FILTER (stage = 'found') AS urls_found FROM run_events GROUP BY run_id""",
    "run_events",
)
def x2(spark, folder):
    path = scratch_dir(spark)
    counters = streams.live_counters(stream_shape(spark, folder, "run_events"))
    streams.each_batch(counters, streams.state_writer(path, ["run_id"]))
    return streams.latest(spark, path, ["run_id"])


def window_sql(step, width):
    return f"""SELECT strftime(w, '%Y-%m-%dT%H:%M:%S') AS window_start, strftime(w + INTERVAL {width} MINUTE, '%Y-%m-%dT%H:%M:%S') AS window_end,
        count(*) AS n_events, round(sum(CAST(round(cost * 1000000) AS BIGINT)) / 1e6, 6) AS cost,
        coalesce(round(count(*) FILTER (stage = 'extracted') / nullif(count(*) FILTER (stage IN ('extracted', 'failed')), 0)::DOUBLE, 6), 0) AS success_rate
        FROM (SELECT *, time_bucket(INTERVAL {step} MINUTE, ts) - INTERVAL {step} MINUTE * unnest(range({width} // {step})) AS w FROM run_events) GROUP BY w"""


def _windows(spark, folder, width, slide=None):
    path = scratch_dir(spark)
    metrics = streams.windowed_metrics(stream_shape(spark, folder, "run_events"), width, slide)
    streams.each_batch(metrics, streams.batch_writer(path))
    rows = streams.latest(spark, path, ["window_start", "window_end"])
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return rows.withColumns({c: F.date_format(c, iso) for c in ("window_start", "window_end")})


@add("x3_tumbling_metrics", window_sql(60, 60), "run_events")
def x3(spark, folder):
    return _windows(spark, folder, "1 hour")


@add("x3_sliding_metrics", window_sql(30, 60), "run_events")
def x3_sliding(spark, folder):
    return _windows(spark, folder, "1 hour", "30 minutes")


REQUESTS = """WITH RECURSIVE e AS (SELECT event_id AS id, ts, event_type AS query, user_id % 3 AS top_k FROM events {0}),
       p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query, top_k ORDER BY ts, id) = 1
         UNION ALL
         SELECT e.id, e.ts, e.query, e.top_k FROM p JOIN e ON e.query = p.query AND e.top_k = p.top_k AND e.ts > p.ts + INTERVAL 1 HOUR
         QUALIFY row_number() OVER (PARTITION BY e.query, e.top_k ORDER BY e.ts, e.id) = 1)
       SELECT id, query, top_k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM p"""


def _requests(events):
    return events.select("event_id", "ts", F.col("event_type").alias("query"), (F.col("user_id") % 3).alias("top_k"))


@add("x4_first_requests", REQUESTS.format(""))
def x4(spark, folder):
    asked = _requests(tables.table(spark, folder, "events"))
    done = lifetime.first_requests(asked, ["query", "top_k"], "ts", "event_id")
    return done.select(F.col("event_id").alias("id"), "query", "top_k", F.date_format("ts", log.ISO).alias("ts"))


# the stream lets a request out when the watermark has passed it
@add("x4_stream_requests", REQUESTS.format("WHERE epoch_us(ts) <= ((SELECT epoch_ms(max(ts)) FROM events) - 3600000) * 1000"))
def x4_stream(spark, folder):
    path = scratch_dir(spark)
    events = _requests(streams.read_stream(spark, f"{folder}/events.parquet", tables.table(spark, folder, "events").schema))
    streams.append_files(streams.first_requests(events, "event_id"), path)
    return spark.read.parquet(path).withColumn("ts", F.date_format("ts", log.ISO))


SESSIONS = """SELECT run_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS started,
    strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') AS ended, count(*) AS n_events,
    CASE WHEN count(*) FILTER (stage = 'extracted') > 0 THEN 'finished' ELSE 'failed' END AS status
  FROM (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM run_events))
  GROUP BY run_id, s"""


@add("x5_run_sessions", SESSIONS, "run_events")
def x5(spark, folder):
    path = scratch_dir(spark)
    # complete mode, so that sessions still open when the table ends are seen too
    sessions = streams.run_sessions(stream_shape(spark, folder, "run_events"))
    streams.each_batch(sessions, streams.batch_writer(path), "complete")
    rows = streams.latest(spark, path, ["run_id", "started", "ended"])
    return rows.withColumns({c: F.date_format(c, log.ISO) for c in ("started", "ended")})


@add(
    "x5_lifecycle",
    """SELECT run_id, CASE WHEN count(*) FILTER (stage = 'extracted') > 0 THEN 'finished'
            WHEN epoch_ms(max(ts)) + 30 * 60000 < (SELECT epoch_ms(max(ts)) FROM run_events) - 60 * 60000 THEN 'failed' ELSE 'running' END AS status,
       count(*) AS n_events, count(*) FILTER (stage = 'extracted') AS extracted FROM run_events GROUP BY run_id""",
    "run_events",
)
def x5_lifecycle(spark, folder):
    path = scratch_dir(spark)
    events = stream_shape(spark, folder, "run_events")
    # the table is one batch; silence is judged when the watermark has reached its end
    streams.each_batch(streams.lifecycle(events), streams.batch_writer(path))
    return streams.latest(spark, path, ["run_id"])


@add(
    "x6_log_stream",
    """SELECT run_id, event_id, stage, cost FROM run_events""",
    "run_events",
)
def x6(spark, folder):
    path = scratch_dir(spark)
    events = stream_shape(spark, folder, "run_events").select("run_id", "event_id", "stage", "cost")
    streams.each_batch(events, streams.batch_writer(path), "append")
    return spark.read.parquet(path).select("run_id", "event_id", "stage", "cost")
