"""Streams over several files give what the batch gives."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gapweave.catalog.base import shape
from gapweave.catalog.extraction import FIELDS
from gapweave.catalog.streams import CONFIG
from gapweave.operators import extract, fetch
from gapweave.session import scratch_dir
from gapweave.streaming import streams


def staged(df, tmp_path, parts):
    path = str(tmp_path / "in")
    df.repartition(parts).write.parquet(path)
    return path


def test_extraction_of_arriving_files_equals_batch(spark, folder, tmp_path):
    scrapes = shape(spark, folder, "scrapes")
    path = staged(scrapes, tmp_path, 5)
    stream = streams.read_stream(spark, path, scrapes.schema, files_per_trigger=2)
    out = scratch_dir(spark)
    streams.append_files(streams.extract_stream(stream, FIELDS, CONFIG), out)
    gated = fetch.size_gate(fetch.extractable(scrapes), CONFIG.min_page_chars).filter("passed")

    def rows(df):
        return sorted((r.url, r.success, str(sorted(r.content.items())), str(r.stage_tokens)) for r in df.collect())

    got = rows(spark.read.parquet(out))
    assert got and got == rows(extract.extract(gated, FIELDS, CONFIG))


def test_counters_over_several_batches(spark, folder, tmp_path):
    events = shape(spark, folder, "run_events")
    path = staged(events, tmp_path, 4)
    stream = streams.read_stream(spark, path, events.schema, files_per_trigger=1)
    out = scratch_dir(spark)
    streams.each_batch(streams.live_counters(stream), streams.batch_writer(out))
    assert spark.read.parquet(out).select("batch").distinct().count() == 4
    got = {tuple(r) for r in streams.latest(spark, out, ["run_id"]).collect()}
    assert got == {tuple(r) for r in streams.live_counters(events).collect()}


def instants(spark, tmp_path, batches, schema):
    """One file per batch, older files first."""
    import os
    import time

    folder = tmp_path / "events"
    folder.mkdir()
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema).coalesce(1)
        stage = tmp_path / f"stage{i}"
        part.write.parquet(str(stage))
        (file,) = stage.glob("*.parquet")
        target = folder / f"{i}.parquet"
        target.write_bytes(file.read_bytes())
        then = time.time() - 1000 + i * 10
        os.utime(target, (then, then))
    return streams.read_stream(spark, str(folder), part.schema, files_per_trigger=1)


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "run_id long, stage string, cost double, ts timestamp_ntz"
    batches = [
        [(1, "extracted", 1.0, at(1)), (1, "failed", 1.0, at(8))],
        # a watermark is applied to late rows one batch after it was reached
        [(1, "failed", 1.0, at(9))],
        [(1, "extracted", 1.0, at(1, 30)), (1, "extracted", 1.0, at(8, 30))],
    ]
    stream = streams.windowed_metrics(instants(spark, tmp_path, batches, schema))
    out = scratch_dir(spark)
    streams.each_batch(stream, streams.batch_writer(out))
    got = {r.window_start.hour: (r.n_events, r.success_rate) for r in streams.latest(spark, out, ["window_start", "window_end"]).collect()}
    assert got == {1: (1, 1.0), 8: (2, 0.5), 9: (1, 0.0)}


@pytest.mark.parametrize("cut", [1, 2, 5, 9])
def test_requests_are_let_through_once_a_lifetime_however_batches_are_cut(spark, tmp_path, cut):
    schema = "id long, query string, top_k int, ts timestamp_ntz"
    rows = [
        (1, "a", 5, at(1)), (2, "a", 5, at(1, 10)), (3, "a", 9, at(1)), (4, "b", 5, at(1)), (5, "a", 5, at(1, 40)),
        (6, "a", 5, at(2, 1)), (7, "a", 5, at(2, 50)), (8, "a", 5, at(3, 30)), (9, "z", 1, at(12)),
    ]
    batches = [rows[k : k + cut] for k in range(0, len(rows), cut)]
    out = scratch_dir(spark)
    streams.append_files(streams.first_requests(instants(spark, tmp_path, batches, schema), "id"), out)
    # the last one is still ahead of the watermark
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3, 4, 6, 8]


def test_runs_finish_or_time_out(spark, tmp_path):
    schema = "run_id long, stage string, ts timestamp_ntz"
    batches = [
        [(1, "found", at(1)), (2, "found", at(1)), (2, "extracted", at(1, 5))],
        [(1, "scraping", at(1, 10)), (3, "found", at(9))],
        [(3, "scraped", at(9, 1))],
        [(3, "extracted", at(9, 2))],
    ]
    stream = streams.lifecycle(instants(spark, tmp_path, batches, schema))
    out = scratch_dir(spark)
    streams.each_batch(stream, streams.batch_writer(out))
    seen = spark.read.parquet(out).orderBy("batch").collect()
    states = {run: [r.status for r in seen if r.run_id == run] for run in (1, 2, 3)}
    assert states[1] == ["running", "running", "failed"]
    assert states[2] == ["finished"]
    assert states[3] == ["running", "running", "finished"]


def test_a_repeated_batch_replaces_itself(spark):
    out = scratch_dir(spark)
    write = streams.batch_writer(out)
    for _ in range(2):
        write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(out).count() == 5


def test_state_is_merged_batch_by_batch(spark):
    out = scratch_dir(spark)
    write = streams.state_writer(out, ["k"])
    for batch, rows in enumerate([[(1, "a"), (2, "a")], [(2, "b")], [(3, "c"), (1, "c")], []]):
        for _ in range(2):  # each batch is run twice
            write(spark.createDataFrame(rows, "k long, v string"), batch)
    assert {r.k: r.v for r in streams.latest(spark, out, ["k"]).collect()} == {1: "c", 2: "b", 3: "c"}
    assert spark.read.parquet(out).count() == 6  # two copies


def test_a_failing_stream_raises(spark, folder):
    events = shape(spark, folder, "run_events")
    stream = streams.read_stream(spark, f"{folder}/events.parquet", spark.read.parquet(f"{folder}/events.parquet").schema)

    def broken(rows, batch_id):
        raise RuntimeError("sink is down")

    with pytest.raises(Exception, match="sink is down"):
        streams.each_batch(stream, broken, "append")
    assert events.select(F.count("*")).first()[0] > 0
