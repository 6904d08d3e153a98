"""The bucketed page store, the filter of asked links, and the log that may be written again."""

from __future__ import annotations

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from gapweave.operators import fetch, link_filter, log
from gapweave.session import scratch_dir
from gapweave.sources import store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged_below(plan: str, scan: str) -> bool:
    """Whether an exchange stands above the scan that reads ``scan``."""
    depth = []
    for line in plan.splitlines():
        level = len(re.match(r"[\s:|+\-]*", line).group())
        depth = [d for d in depth if d[0] < level]
        depth.append((level, line))
        if "FileScan" in line and scan in line:
            return any("Exchange" in text for _, text in depth)
    raise AssertionError(plan)


@pytest.fixture
def pages(spark):
    return spark.range(2000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://h.org/"), "id").alias("url"), F.concat(F.lit("<p>body "), "id", F.lit("</p>")).alias("html")
    )


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bodies_in_buckets_are_not_shuffled(spark, pages, no_broadcast):
    requests = spark.range(3000).select((F.col("id") % 50).alias("entity_id"), F.concat(F.lit("https://h.org/"), F.col("id") * 2).alias("url"))
    kept = store.save_store(pages, f"pages_{uuid.uuid4().hex}", scratch_dir(spark), 8)
    plan = plan_of(fetch.fetch(requests, kept))
    assert "Bucketed: true" in plan and not exchanged_below(plan, "html")
    plain = spark.read.parquet(kept.inputFiles()[0].rsplit("/", 1)[0])
    assert exchanged_below(plan_of(fetch.fetch(requests, plain)), "html")
    got = fetch.fetch(requests, kept)
    assert sorted(got.collect(), key=str) == sorted(fetch.fetch(requests, plain).collect(), key=str)
    assert len(kept.inputFiles()) == 8  # a file for each bucket


def test_unasked_bodies_stay_in_the_scan(spark, pages, no_broadcast):
    links = spark.range(0, 2000, 40).select(F.concat(F.lit("https://h.org/"), "id").alias("url")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    words, bits = link_filter.link_filter(links)
    passed = pages.filter(link_filter.may_hold(words, bits, F.col("url")))
    asked = {r.url for r in links.collect()} - {None}
    through = {r.url for r in passed.collect()}
    assert asked <= through
    assert len(through - asked) / (2000 - len(asked)) < 0.03
    got = link_filter.asked_pages(pages, links)
    assert {r.url for r in got.collect()} == asked
    # the test of the filter stands below the exchange that carries the bodies
    plan = plan_of(got)
    assert plan.rindex("bit_get") > plan.index("Exchange hashpartitioning(url")


def test_share_of_links_let_through(spark):
    links = spark.range(20000).select(F.concat(F.lit("a"), "id").alias("url"))
    words, bits = link_filter.link_filter(links)
    others = spark.range(100000).select(F.concat(F.lit("b"), "id").alias("url"), F.lit(1).alias("one"))
    assert others.filter(link_filter.may_hold(words, bits, F.col("url"))).count() < 1500
    assert links.filter(~link_filter.may_hold(words, bits, F.col("url"))).count() == 0


def test_size_of_the_filter_has_a_bound():
    assert link_filter.filter_bits(0) == link_filter.WORD
    assert link_filter.filter_bits(10**12) == link_filter.MOST_BITS


def test_no_links_and_no_pages(spark, pages):
    none = spark.createDataFrame([], "url string")
    assert link_filter.asked_pages(pages, none).count() == 0
    assert link_filter.asked_pages(pages.limit(0), pages.select("url")).count() == 0


def _log(spark, first=0):
    day = F.lit(dt.date(2025, 1, 1)).alias("run_date")
    runs = spark.range(first, first + 5).select(F.col("id").alias("run_id"), day)
    return {log.RUNS: runs, log.SCRAPES: runs.withColumn("url", F.lit("u"))}


def test_a_write_that_broke_off_shows_nothing_and_is_tried_again(spark):
    path = scratch_dir(spark)
    log.write_log(_log(spark), path, "one")
    broken = _log(spark, 5)
    broken[log.SCRAPES] = broken[log.SCRAPES].withColumn("url", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        log.write_log(broken, path, "two")

    def counts():
        return {name: t.count() for name, t in log.read_log(spark, path, names=(log.RUNS, log.SCRAPES)).items()}

    assert counts() == {log.RUNS: 5, log.SCRAPES: 5}
    for _ in range(2):  # once more, and again
        log.write_log(_log(spark, 5), path, "two")
        assert counts() == {log.RUNS: 10, log.SCRAPES: 10}
    assert log.write_log(_log(spark, 10), path) != log.write_log(_log(spark, 10), path)
    assert counts() == {log.RUNS: 20, log.SCRAPES: 20}


def test_log_tables_by_name(spark):
    root, prefix = scratch_dir(spark), f"t_{uuid.uuid4().hex}_"
    names = log.write_log_tables(_log(spark), root, "prod", prefix)
    log.write_log_tables(_log(spark, 5), root, "prod", prefix)
    assert names[log.RUNS] == f"`production`.`{prefix}runs`" and spark.table(names[log.RUNS]).count() == 10
    assert [r[0] for r in spark.sql(f"SHOW PARTITIONS {names[log.RUNS]}").collect()] == ["run_date=2025-01-01"]
