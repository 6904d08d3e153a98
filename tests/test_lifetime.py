"""Requests let through once in a lifetime, against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from gapweave.operators import lifetime, metrics

START = dt.datetime(2025, 1, 1)


def brute(rows, seconds):
    last, out = {}, set()
    for key, ts, unique in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2])):
        if key not in last or (ts - last[key]).total_seconds() > seconds:
            last[key] = ts
            out.add((key, ts, unique))
    return out


def let_through(spark, rows, seconds=3600):
    df = spark.createDataFrame(rows, "query string, ts timestamp, id long")
    return {tuple(r) for r in lifetime.first_requests(df, ["query"], "ts", "id", seconds).collect()}


def test_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "hot", "hot"]), START + dt.timedelta(seconds=rng.randrange(400000)), i) for i in range(1500)]
    # ties, exact distances of one lifetime, rows without an instant
    rows += [("tie", START + dt.timedelta(hours=h), 5000 + 10 * h + k) for h in range(6) for k in range(3)]
    rows += [("c", None, 1), ("once", START, 2)]
    assert let_through(spark, rows) == brute(rows, 3600)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    step = lifetime._step
    monkeypatch.setattr(lifetime, "_step", lambda *a: rounds.append(1) or step(*a))
    rows = [("k", START + dt.timedelta(minutes=61 * i), i) for i in range(300)]
    assert let_through(spark, rows) == brute(rows, 3600) and len(rounds) <= 2 * 10


def test_no_rows(spark):
    assert let_through(spark, []) == set()


def test_hits_without_a_channel_are_not_the_total(spark):
    hits = spark.createDataFrame([(1, None, 1, "l", "t"), (1, "x", 1, "m", "u")], "entity_id long, channel string, channel_rank int, link string, title string")
    usage = spark.createDataFrame([(None, 1.0, 2.0), ("x", 3.0, 4.0)], "channel string, cost double, elapsed double")
    rows = {r.channel: (r.results, r.cost, r.channels) for r in metrics.channel_statistics(hits, usage).collect()}
    assert rows == {None: (1, 1.0, 1), "x": (1, 3.0, 1), "(all)": (2, 4.0, 2)}


def test_hosts_with_gated_pages_only_are_reported(spark):
    from gapweave.config import Field
    from gapweave.plans import jobs

    pages = spark.createDataFrame(
        [("https://a.org/1", "Voltage: 5 V" + "x" * 100), ("https://a.org/2", "Voltage: 6 V"), ("https://b.org/1", "short"), ("https://b.org/2", None)],
        "url string, html string",
    )
    got = jobs.host_profile(pages, [Field("voltage", "v", pattern=r"Voltage: ([0-9.]+ ?V)", on_page=True)], 50)
    rows = {(r.host, r.field, r.value, r.n_pages, r.n_gated) for r in got.collect()}
    assert rows == {("a.org", "voltage", "5 V", 1, 1), ("b.org", None, None, 0, 2)}
    assert got.select(F.sum("n_chars")).first()[0] == 112
