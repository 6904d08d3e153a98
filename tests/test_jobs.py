"""Whole jobs, the run log and the hooks."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gapweave.catalog import storage
from gapweave.catalog.extraction import FIELDS
from gapweave.config import MODE_FALLBACK, MODE_ONLY, FastPath, Field, RunConfig
from gapweave.operators import fetch, hooks, log
from gapweave.plans import jobs
from gapweave.session import hand_over, scratch_dir

ENTITY = "entity_id long, name string, identifier_context string, impute_task_purpose string"


@pytest.fixture(scope="module")
def pages(spark):
    def page(i, title, body):
        return (i, f"https://p{i}.example.org/", f"<html><title>{title}</title><body>{body}{'<p>filler</p>' * 20}</body></html>")

    rows = [
        page(1, "BAV99 diode", "<p>Voltage: 75V</p><p>Voltage: 75V</p><p>Voltage: 80V</p>"),
        page(2, "BAV99 switching diode", "<p>Voltage: 75V</p>"),
        page(3, "BAV99", "<p>Voltage: 80V</p>"),
        (4, "https://p4.example.org/", "<title>BAV99</title>"),
        page(5, "BC547 transistor", "<p>no value</p>"),
        (6, "https://facebook.com/bav99", "<title>BAV99 BAV99 BAV99</title>" + "<p>Voltage: 1V</p>" * 50),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


VOLTAGE = [Field("voltage", "reverse voltage", pattern=r"Voltage: ([0-9]+V)")]


def test_impute_batch(spark, pages):
    entities = spark.createDataFrame(
        [(1, "BAV99", None, None), (2, "BC547", "", None), (3, "nothing like it", None, None), (4, "  ", None, None)], ENTITY
    )
    run = jobs.impute_batch(entities, VOLTAGE, pages, RunConfig(top_k=5, min_page_chars=200))
    values = {r.entity_id: (r.value, r.votes) for r in run.values.collect()}
    # page 1 contradicts itself and stays below the threshold; 75V and 80V are tied at one page each
    assert values == {1: ("80V", 1)}
    runs = {r.entity_id: r for r in run.runs.collect()}
    assert (runs[1].status, runs[1].urls_found, runs[1].urls_too_small, runs[1].urls_extracted) == ("finished", 4, 1, 3)
    assert (runs[2].status, runs[2].error) == ("failed", jobs.NO_EXTRACTS)
    assert (runs[3].status, runs[3].error, runs[3].urls_found) == ("failed", jobs.NO_RESULTS, 0)
    assert runs[4].status == "failed"
    started = dt.datetime(2025, 5, 1)
    logged = jobs.log_tables(run, entities, VOLTAGE, started, started)
    path = jobs.write_log(logged, scratch_dir(spark))
    back = jobs.read_log(spark, path, 1, log.TABLES)
    assert [(r.query, r.status, r.status_details.urls_extracted) for r in back["runs"].collect()] == [("BAV99", "finished", 3)]
    assert back["hits"].count() == 4 and [r.value for r in back["values"].collect()] == ["80V"]
    assert [r.message.startswith("Scrape for https://p4") for r in back["errors"].collect()] == [True]
    assert {json.loads(r.content)["voltage"][0] for r in back["extracts"].collect()} == {"75V", "80V"}
    target = spark.createDataFrame([(10, 1, None), (11, 1, "5V"), (12, 2, None)], "id long, entity_id long, voltage string")
    filled = {r.id: (r.voltage, r.voltage_source) for r in jobs.fill_table(target, run.values, ["voltage"]).collect()}
    assert filled == {10: ("80V", "https://p3.example.org/"), 11: ("5V", None), 12: (None, None)}


def test_missing_pages_give_failed_rows(spark, pages):
    links = spark.createDataFrame([(1, "https://gone.example.org/"), (1, "https://p2.example.org/")], "entity_id long, url string")
    config = RunConfig(min_page_chars=200)
    got = {r.url: r for r in jobs.link_results(links, jobs.page_results(pages, VOLTAGE, config)).collect()}
    assert (got["https://gone.example.org/"].status, got["https://gone.example.org/"].error) == ("failed", fetch.NO_PAGE)
    assert got["https://p2.example.org/"].content == {"voltage": ["75V"]}


def test_fast_path_modes(spark):
    base = "https://www.digikey.com/en/products/result?keywords="
    entities = spark.createDataFrame([(1, "good", None, None), (2, "empty", None, None), (3, "unknown", None, None)], ENTITY)
    answers = spark.createDataFrame(
        [(base + "good", True, '[{"a":1}]', "json", None), (base + "empty", True, "[]", "json", None)],
        "url string, success boolean, data string, data_kind string, error string",
    )

    def states(**kw):
        out = jobs.fast_path(entities, answers, RunConfig(fast_path=FastPath(**kw)))
        return {r.entity_id: (r.goes_on, r.status) for r in out.collect()}

    assert states(mode=MODE_ONLY) == {1: (False, "finished"), 2: (False, "finished"), 3: (False, "failed")}
    assert states(mode=MODE_FALLBACK) == {1: (False, "finished"), 2: (True, "running"), 3: (True, "running")}
    assert states(mode=MODE_FALLBACK, always_continue=True)[1] == (True, "running")
    assert states()[1] == (True, "running")
    reasons = jobs.fast_path_errors(entities, answers, RunConfig()).collect()
    assert [r.reason for r in reasons] == [(base + "empty")[:50] + "...: Empty data"]


def test_vendors_first_in_a_whole_run(spark, pages):
    base = "https://www.digikey.com/en/products/result?keywords="
    entities = spark.createDataFrame([(1, "good", None, None), (2, "BAV99", None, None), (3, "none", None, None), (4, " ", None, None)], ENTITY)
    answers = spark.createDataFrame(
        [(base + "good", True, '[{"voltage":"1V"},{"voltage":"9V","x":2}]', "json", None, 0.5), (base + "BAV99", True, "[]", "json", None, 0.25)],
        "url string, success boolean, data string, data_kind string, error string, cost double",
    )
    usage = spark.createDataFrame([(2, {"total_cost": 4e-7}), (2, {"cost": 4e-7})], "entity_id long, usage map<string,double>")
    searched = spark.createDataFrame([(2, 1.0)], "entity_id long, cost double")
    fallback = RunConfig(top_k=5, min_page_chars=200, fast_path=FastPath(mode=MODE_FALLBACK))
    run = jobs.impute_batch(entities, VOLTAGE, pages, fallback, answers, searched, usage)
    assert {r.entity_id: r.value for r in run.values.collect()} == {1: "9V", 2: "80V"}
    runs = {r.entity_id: (r.status, r.error) for r in run.runs.collect()}
    assert runs == {1: ("finished", None), 2: ("finished", None), 3: ("failed", jobs.NO_RESULTS), 4: ("failed", jobs.NO_RESULTS)}
    costs = {r.entity_id: (r.serp_cost, r.scrape_cost, r.extraction_cost, r.total_cost) for r in run.costs.collect()}
    assert costs[1] == (0.0, 0.5, 0.0, 0.5) and costs[2] == (1.0, 0.25, 1e-6, 1.250001) and costs[3] == (0.0, 0.0, 0.0, 0.0)
    only = jobs.impute_batch(entities, VOLTAGE, pages, RunConfig(fast_path=FastPath(mode=MODE_ONLY)), answers)
    runs = {r.entity_id: (r.status, r.error) for r in only.runs.collect()}
    assert runs == {
        1: ("finished", None), 2: ("finished", (base + "BAV99")[:50] + "...: Empty data"),
        3: ("failed", jobs.FAST_NO_RESULTS), 4: ("failed", jobs.NO_RESULTS),
    }


def test_budget_flow(spark):
    page = "<title>t</title>" + "<p>Voltage: 75V</p>" * 20
    schema = "entity_id long, url string, status string, success boolean, data string, cost double, error string, data_kind string"
    first = spark.createDataFrame(
        [(1, "a", "ready", True, page, 90.0, None, "html"), (1, "b", "failed", False, None, 20.0, "x", "html"),
         (2, "c", "failed", False, None, 1.0, "x", "html")], schema,
    )
    second = spark.createDataFrame([(e, u, "ready", True, page, 0.1, None, "html") for e, u in ((1, "b"), (2, "c"), (1, "z"))], schema)
    runs, values = jobs.flow_with_budget(first, second, VOLTAGE, RunConfig(min_page_chars=100))
    got = {r.entity_id: (r.budget_mode, r.successful_scrapes, r.status, r.error) for r in runs.collect()}
    # entity 2 was cheap, so its failed link is not tried again; "z" was never asked for
    assert got == {1: (True, 2, "finished", None), 2: (False, 0, "failed", jobs.NO_SCRAPES)}
    assert [(r.entity_id, r.value, r.votes) for r in values.collect()] == [(1, "75V", 2)]


def test_log_round_trip(spark, folder):
    written = storage.run_tables(spark, folder)
    runs, scrapes = written[log.RUNS], written[log.SCRAPES]
    path = jobs.write_log(written, scratch_dir(spark), "prod")
    assert path.endswith("/production/run_log")
    some = runs.orderBy("run_id").first()
    one, s, e = jobs.read_log(spark, path, some.run_id).values()
    back = one.first()
    assert back.performance == some.performance and back.costs == some.costs and back.created_at == some.created_at
    assert [f.name for f in back.schema] == [f.name for f in FIELDS]
    assert s.count() == scrapes.filter(F.col("run_id") == some.run_id).count()
    assert e.count() == back.performance.successful_extractions
    assert all(t.count() == 0 for t in jobs.read_log(spark, path, -1).values())
    with pytest.raises(ValueError):
        log.write_log({"other": runs}, path)
    record = json.loads(log.export_runs(one).first().record)
    assert record["created_at"].startswith("2024-01-") and record["performance"]["urls_found"] == some.performance.urls_found


def test_saved_pages_are_not_overwritten_unasked(spark):
    schema = "url string, status string, success boolean, data string, data_kind string"
    rows = [("a", "ready", True, "x", "html"), ("b", "ready", True, "", "html"), ("c", "failed", False, None, "html"), ("d", "ready", True, "{}", "json")]
    df = spark.createDataFrame(rows, schema)
    path = scratch_dir(spark)
    log.save_pages(df, path)
    assert {(r.url, r.data_kind) for r in spark.read.parquet(path).collect()} == {("a", "html"), ("d", "json")}
    with pytest.raises(AnalysisException):
        log.save_pages(df, path)
    log.save_pages(df.filter("url = 'a'"), path, overwrite=True)
    assert spark.read.parquet(path).count() == 1


def test_a_log_table_without_rows_is_read(spark, pages):
    """Where no page is too small or without values, nothing is logged as an error."""
    entities = spark.createDataFrame([(1, "switching", None, None)], ENTITY)
    run = jobs.impute_batch(entities, VOLTAGE, pages, RunConfig(top_k=5, min_page_chars=200))
    started = dt.datetime(2025, 5, 1)
    logged = jobs.log_tables(run, entities, VOLTAGE, started, started)
    path = jobs.write_log(logged, scratch_dir(spark))
    back = jobs.read_log(spark, path, names=log.TABLES)
    assert {name: t.count() for name, t in back.items()} == {"runs": 1, "hits": 1, "scrapes": 1, "extracts": 1, "values": 1, "errors": 0}
    assert all(t.columns == logged[name].columns and t.schema["run_date"].dataType.typeName() == "date" for name, t in back.items())


def test_log_paths():
    assert log.log_path("/x/", "prod") == "/x/production/run_log"
    assert log.log_path("/x", "anything") == "/x/test/run_log"


def test_hooks_never_raise(spark):
    df = spark.createDataFrame([(1, "a", "good"), (1, "b", "bad")], "entity_id long, url string, data string")

    def extractor(text, fields):
        if text == "bad":
            raise RuntimeError("no")
        return {f.name: text for f in fields}

    got = {r.url: (r.success, r.error, r.content) for r in hooks.extract_with(df, extractor, VOLTAGE).collect()}
    assert got == {"a": (True, None, '{"voltage": "good"}'), "b": (False, "RuntimeError: no", None)}

    def fetcher(links):
        if links == ["b"]:
            raise TimeoutError("late")
        return [{"status": "ready", "data": "<p>", "cost": 0.5}]

    fetched = hooks.fetch_with(df, fetcher, 2)
    assert fetched.rdd.getNumPartitions() == 2
    assert {r.url: (r.status, r.cost, r.error) for r in fetched.collect()} == {"a": ("ready", 0.5, None), "b": ("failed", 0.0, "TimeoutError: late")}


def test_hand_over_keeps_rows_and_schema(spark):
    df = spark.range(5).select("id", F.create_map(F.lit("k"), F.array("id")).alias("m"))
    back = hand_over(df)
    # columns read from files may always be null
    assert back.dtypes == df.dtypes and sorted(r.id for r in back.collect()) == list(range(5))
    assert hand_over(df.filter("id > 9")).count() == 0


def test_text_files_as_pages(spark, tmp_path):
    from gapweave.sources.tables import text_pages

    (tmp_path / "a.html").write_text("<p>ä\nb</p>", encoding="utf-8")
    row = text_pages(spark, str(tmp_path)).first()
    assert row.html == "<p>ä\nb</p>" and row.url.endswith("a.html")
