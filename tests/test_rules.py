"""Small hand-made cases for the rules of each operator."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gapweave import config
from gapweave.config import FastPath, Field, RunConfig
from gapweave.functions import content, html, urls, usage
from gapweave.operators import extract, fetch, gather, hits, metrics, timing, vendor
from gapweave.sources import tables


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


# --- entities, fields, presets ---------------------------------------------------------


def test_blank_entities_are_rejected(spark):
    e = spark.createDataFrame([(1, "bav99"), (2, ""), (3, "   "), (4, None), (5, "\t\n")], "entity_id long, name string")
    assert [r.entity_id for r in tables.valid_entities(e).collect()] == [1]
    with pytest.raises(PySparkException):
        tables.valid_entities(e, strict=True).collect()


def test_query_skips_empty_parts(spark):
    rows = [("bav99", "electronic component", "testing"), ("bav99", None, ""), ("bav99", "", "testing")]
    col = urls.build_query(F.col("n"), F.col("c"), F.col("p"))
    assert one(spark, rows, "n string, c string, p string", col) == ["bav99 electronic component testing", "bav99", "bav99 testing"]


def test_fields_need_name_and_description():
    with pytest.raises(ValueError):
        Field(" ", "x")
    with pytest.raises(ValueError):
        Field("x", "")


def test_presets():
    dev, prod, default = config.development_config(), config.production_config(), config.default_config()
    assert (dev.top_k, default.top_k, prod.top_k) == (5, 10, 15)
    assert (dev.min_page_chars, default.min_page_chars, prod.min_page_chars) == (3000, 5000, 10000)
    assert config.fast_only_config().fast_path.mode == "fast_path_only"
    assert config.fast_with_fallback_config().fast_path.min_result_size == 5000
    assert prod.fast_path.min_result_size == 10000
    with pytest.raises(ValueError):
        RunConfig(top_k=0)
    with pytest.raises(ValueError):
        FastPath(mode="sometimes")


# --- links -------------------------------------------------------------------------------


def test_valid_links(spark):
    links = [
        "https://valid-site.com",
        "http://another-valid.org",
        "https://facebook.com/blocked",
        "invalid-url",
        "https://example.pdf",
        None,
        " https://valid-site.com ",
        "HTTPS://upper.example.com",
        "https://ok.org/?via=Reddit.com",
    ]
    rows = [(u,) for u in links]
    valid = one(spark, rows, "u string", urls.is_valid_url(F.col("u")))
    assert valid == [True, True, False, False, True, False, True, False, False]
    files = one(spark, rows, "u string", urls.is_file_link(F.col("u")))
    assert [u for u, f in zip(links, files) if f] == ["https://example.pdf"]
    assert one(spark, [("https://ok.org/?via=Reddit.com",)], "u string", urls.is_valid_url(F.col("u"), match_host=True)) == [True]


def test_top_k_bounds(spark):
    df = spark.createDataFrame([(1, 1)], "g int, x int")
    with pytest.raises(ValueError):
        hits.top_k(df, ["g"], ["x"], 0)
    assert hits.top_k(spark.range(6000).selectExpr("1 AS g", "id AS x"), ["g"], ["x"], 5000).count() == 5000


def test_unusable_links_take_no_place(spark):
    rows = [(1, "a", 0, i, f"http://x.org/{i}.pdf" if i <= 15 else f"http://x.org/{i}") for i in range(1, 31)]
    df = spark.createDataFrame(rows, "entity_id long, channel string, channel_order int, channel_rank long, link string")
    assert [r.link for r in hits.select_links(df, 10).orderBy("pos").collect()] == [f"http://x.org/{i}" for i in range(16, 26)]


def test_unused_channels_unknown_costs_and_confidences(spark):
    found = spark.createDataFrame([("a", 1, "l1", "t"), ("b", 1, "l2", "u")], "channel string, channel_rank long, link string, title string")
    used = spark.createDataFrame([("a", 1.5, 2.0), ("c", 0.5, 1.0)], "channel string, cost double, elapsed double")
    got = {r.channel: (r.results, r.cost, r.channels) for r in metrics.channel_statistics(found, used).collect()}
    assert got == {"a": (1, 1.5, 1), "b": (1, None, 1), "c": (0, 0.5, 1), "(all)": (2, 2.0, 3)}
    events = spark.createDataFrame([(1, "x", 5.0, "scraped"), (1, "y", None, "scraped")], "run_id long, url string, cost double, stage string")
    assert metrics.cost_extremes(events, 10).first().most_expensive_url == "x"
    values = spark.createDataFrame([(1, "f", "v", 0.9, "good"), (1, "f", "v", None, "none")], "entity_id long, field string, value string, confidence double, url string")
    fused = gather.fuse(values).first()
    assert (fused.confidence, fused.source_url) == (0.9, "good")


def test_very_small_costs_add_up(spark):
    many = spark.range(1_000_000).selectExpr("1 AS run_id", "4e-7D AS cost")
    assert many.agg(usage.exact_sum(F.col("cost")).alias("s")).first().s == 0.4


def test_values_do_not_depend_on_the_size_of_the_page(spark):
    fields = [
        Field("lang", "language", pattern='<html lang="([a-z]+)"', on_page=True),
        Field("late", "far down", pattern="LATE=([0-9]+)", on_page=True),
        Field("kept", "in the text", pattern="kept: ([0-9]+)", keywords=("kept",)),
    ]
    start = '<html lang="en"><body><p>kept: 5</p>'
    rows = [("short", start + "LATE=7</body></html>"), ("long", start + "<p>filler</p>" * 20_000 + "LATE=7</body></html>")]
    scrapes = spark.createDataFrame(rows, "url string, data string").selectExpr("1L AS entity_id", "url", "data", "true AS success", "'ready' AS status")
    got = {r.url: r.content for r in extract.extract(scrapes, fields, RunConfig()).collect()}
    assert got["short"] == got["long"] == {"lang": ["en"], "late": ["7"], "kept": ["5"]}


def test_select_links_mixes_deduplicates_and_trims(spark):
    rows = []
    for c, (channel, names) in enumerate([("a", "pqrs"), ("b", "qtpu")]):
        rows += [(1, channel, c, r + 1, f"http://{n}.org/", n) for r, n in enumerate(names)]
    rows.append((1, "b", 1, 5, "http://facebook.com/x", "f"))
    df = spark.createDataFrame(rows, "entity_id long, channel string, channel_order int, channel_rank long, link string, title string")
    picked = {r.pos: r.title for r in hits.select_links(df, 4).collect()}
    assert picked == {1: "p", 2: "q", 3: "t", 4: "r"}
    plain = {r.pos: r.title for r in hits.select_links(df, 6, interleaved=False).collect()}
    assert "".join(plain[i] for i in sorted(plain)) == "pqrstu"


# --- content ------------------------------------------------------------------------------


NORMALISED = [
    ('{"a":1}', {"a": "1"}),
    ('[{"a":1},{"a":2,"b":3}]', {"a": "2", "b": "3"}),
    ("[]", {}),
    ('[1,"x"]', {"item_0": "1", "item_1": "x"}),
    ('[{"a":1},5]', {"item_0": '{"a":1}', "item_1": "5"}),
    ('"s"', {"value": "s"}),
    ("5", {"value": "5"}),
    ("true", {"value": "true"}),
    ("null", None),
    ("not json", None),
    ('{"a":', None),
    (None, None),
    ('{"a":{"b":[1]},"c":null}', {"a": '{"b":[1]}', "c": None}),
]


def test_normalise(spark):
    got = one(spark, [(j,) for j, _ in NORMALISED], "j string", content.normalise(F.col("j")))
    assert got == [want for _, want in NORMALISED]


def test_fences(spark):
    rows = [('```json\n{"a":1}\n```',), ('```\n[1]\n```',), ('{"a":1}',)]
    assert one(spark, rows, "j string", content.strip_fence(F.col("j"))) == ['{"a":1}', "[1]", '{"a":1}']


def test_json_fields(spark):
    fields = [Field("name", "x"), Field("price", "y")]
    rows = [('{"name":"a","price":5,"other":1}',), ('{"name":"a"}',), ("[1]",), ("oops",), (None,)]
    out = extract.extract_json(spark.createDataFrame(rows, "j string"), fields).collect()
    assert [r.success for r in out] == [True, True, False, False, False]
    assert out[0].content == {"name": "a", "price": "5"}
    assert out[1].content == {"name": "a", "price": None}
    assert out[2].error == "expected an object, got list" and out[3].error == "invalid JSON"


def test_fast_path_size_and_use(spark):
    rows = [("x" * 1000, "html", True), ("x" * 999, "html", True), ("[1]", "json", True), ("[]", "json", True),
            ('{"a": 1}', "json", True), ("{}", "json", True), ('{"a":1}', "json", False), (None, "json", True)]
    use = content.fast_path_usable(F.col("s"), F.col("d"), F.col("k"), 1000)
    assert one(spark, rows, "d string, k string, s boolean", use) == [True, False, True, False, True, False, False, False]
    size = content.fast_path_size(F.col("d"), F.col("k"))
    assert one(spark, rows, "d string, k string, s boolean", size) == [1000, 999, 1000, 0, 7, 2, 7, 0]


# --- pages ---------------------------------------------------------------------------------


PAGE = """<html lang="en"><head><title>Part</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="x"><nav>menu</nav><!-- ad --><h1>BAV99</h1><p>Voltage: 75V</p><p>Current: 215mA
<h2>Other</h2><ul><li>voltage of others</li><li></li><li>nothing &amp;lt;</li></ul></body></html>"""


def test_reduce_and_text(spark):
    reduced, text = spark.createDataFrame([(PAGE,)], "h string").select(html.reduce_html(F.col("h")), html.html_to_text(F.col("h"))).first()
    assert "script" not in reduced and "class" not in reduced and "<h1>BAV99</h1>" in reduced
    assert text.startswith("Part menu BAV99 Voltage: 75V") and text.endswith("nothing &lt;")


def test_blocks_and_strategies(spark):
    pages = spark.createDataFrame([("u", PAGE), ("empty", ""), ("broken", "<p><b>voltage<p")], "url string, html string")
    blocks = [(r.section, r.block) for r in extract.block_rows(pages).filter("url = 'u'").orderBy("pos").collect()]
    assert blocks == [(0, "Part"), (0, "menu"), (1, "BAV99"), (1, "Voltage: 75V"), (1, "Current: 215mA"), (2, "Other"), (2, "voltage of others"), (2, "nothing &amp;lt;")]
    field = Field("voltage", "reverse voltage", pattern=r"Voltage: ([0-9]+V)")
    out = extract.filter_pages(pages, [field], (*extract.STRATEGIES, "unheard of"))
    got = {(r.url, r.strategy): r.filtered for r in out.collect()}
    sep = extract.SEPARATOR
    assert got["u", "base"] == sep.join(["Voltage: 75V", "voltage of others"])
    assert got["u", "recall"] == sep.join(b for _, b in blocks[2:])
    assert got["u", "contextual"] == sep.join(b for _, b in blocks[2:])
    assert got["empty", "base"] == "" and got["empty", "liberal"] == extract.NO_CONTENT
    assert got["broken", "base"] == "voltage<p"


def test_extract_keeps_only_wanted_fields_and_failed_rows(spark):
    fields = [
        Field("voltage", "volts", pattern=r"Voltage: ([0-9]+V)", keywords=("voltage",)),
        Field("title", "t", pattern=r"<title>(.*?)</title>", on_page=True),
        Field("mail", "m", pattern=r"(\S+@\S+)"),
    ]
    rows = [(1, "u", "ready", PAGE), (1, "v", "failed", None), (1, "w", "ready", ""), (2, "x", "ready", "<p>nothing here</p>")]
    df = spark.createDataFrame(rows, "entity_id long, url string, status string, data string")
    out = {r.url: r for r in extract.extract(df, fields, RunConfig()).collect()}
    assert set(out) == {"u", "x"}
    assert out["u"].content == {"voltage": ["75V"], "title": ["Part"], "mail": None}
    assert out["x"].success is False and out["x"].error == extract.NOTHING_FOUND
    values = {(r.field, r.value): r.confidence for r in extract.value_rows(extract.extract(df, fields, RunConfig())).collect()}
    assert values == {("voltage", "75V"): 1.0, ("title", "Part"): 1.0}


def test_trim_records_where(spark):
    df = spark.createDataFrame([("u", "x" * 12), ("v", "x" * 10)], "url string, data string")
    got = {r.url: (len(r.data), r.trimmed_to) for r in fetch.trim_long(df, 10).collect()}
    assert got == {"u": (10, 10), "v": (10, None)}


# --- fetched pages -----------------------------------------------------------------------


SCRAPES = "entity_id long, url string, status string, success boolean, data string, cost double, error string, data_kind string"


def scrape(url, status, cost=0.1, entity=1, data="d"):
    ok = status == "ready"
    return (entity, url, status, ok, data if ok else None, cost, None if ok else "boom", "html")


def test_merge_attempts(spark):
    first = spark.createDataFrame([scrape("a", "ready", 1.0), scrape("b", "failed", 2.0), scrape("c", "failed", 3.0)], SCRAPES)
    second = spark.createDataFrame(
        [scrape("a", "ready", 10.0), scrape("b", "ready", 20.0), scrape("c", "failed", 30.0), scrape("d", "failed", 40.0)], SCRAPES
    )
    got = {r.url: (r.status, r.cost) for r in fetch.merge_attempts(first, second).collect()}
    assert got == {"a": ("ready", 1.0), "b": ("ready", 20.0), "c": ("failed", 3.0), "d": ("failed", 40.0)}
    assert {r.url for r in fetch.retry_set(first).collect()} == {"b", "c"}
    updated = {r.url: r.cost for r in fetch.update_rows(first, second, fetch.KEY).collect()}
    assert updated == {"a": 10.0, "b": 20.0, "c": 30.0, "d": 40.0}


def test_fetch_gives_a_row_for_every_link(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "a"), (1, "x")], "entity_id long, url string")
    pages = spark.createDataFrame([("a", "<p>")], "url string, html string")
    got = {(r.entity_id, r.url): (r.status, r.error, r.cost) for r in fetch.fetch(requests, pages).collect()}
    assert got == {(1, "a"): ("ready", None, 0.0), (2, "a"): ("ready", None, 0.0), (1, "x"): ("failed", fetch.NO_PAGE, 0.0)}


def test_texts_of_a_large_key_are_numbered_rows(spark):
    df = spark.range(2500).select(
        F.when(F.col("id") < 2400, 1).otherwise(F.col("id")).alias("entity_id"), F.lpad(F.col("id").cast("string"), 5, "0").alias("url")
    )
    got = {(r.entity_id, r.nr): r.text for r in fetch.numbered_texts(df, ["entity_id"], "url", "url").collect()}
    assert got == {(1, i + 1): f"{i:05d}" for i in range(2400)} | {(i, 1): f"{i:05d}" for i in range(2400, 2500)}


def test_size_gate(spark):
    df = spark.createDataFrame([("http://a.org/" + "x" * 60, "abc"), ("b", "abcdef")], "url string, data string")
    small, big = fetch.size_gate(df, 5).orderBy("n_chars").collect()
    assert small.gate_error == "Scrape for " + ("http://a.org/" + "x" * 60)[:40] + "... too small: 3 chars"
    assert big.passed and big.gate_error is None


def test_cost_analysis_ties_and_nulls(spark):
    df = spark.createDataFrame([scrape("b", "ready", 0.5), scrape("a", "ready", 0.5), scrape("c", "failed", None)], SCRAPES)
    r = metrics.scrape_cost_analysis(df).first()
    assert (r.most_expensive_url, r.cheapest_url, r.total_cost, r.success_rate) == ("a", "c", 1.0, 0.666667)
    empty = metrics.scrape_costs(df.filter("false")).first()
    assert empty.total_cost == 0.0 and empty.avg_cost_per_successful == 0.0


# --- gathering ----------------------------------------------------------------------------


def test_higher_confidence_wins(spark):
    rows = [(1, "voltage", "80V", 0.8, "u2"), (1, "voltage", "75V", 0.9, "u1"), (1, "type", None, 0.99, "u1"), (1, "type", "diode", 0.1, "u2")]
    df = spark.createDataFrame(rows, "entity_id long, field string, value string, confidence double, url string")
    got = {r.field: (r.value, r.source_url) for r in gather.fuse(df).collect()}
    assert got == {"voltage": ("75V", "u1"), "type": ("diode", "u2")}


def test_votes_break_ties_then_value(spark):
    rows = [(1, "f", "x", 0.9, "u1"), (1, "f", "y", 0.9, "u2"), (1, "f", "y", 0.2, "u3"), (2, "f", "x", 0.9, "u1"), (2, "f", "y", 0.9, "u2")]
    df = spark.createDataFrame(rows, "entity_id long, field string, value string, confidence double, url string")
    assert {r.entity_id: r.value for r in gather.fuse(df).collect()} == {1: "y", 2: "y"}
    a = {r.entity_id: (r.distinct_values, r.top_value, r.agreement) for r in gather.agreement(df).collect()}
    assert a == {1: (2, "y", 0.666667), 2: (2, "y", 0.5)}


def test_relaxed_threshold_only_where_needed(spark):
    rows = [(1, 0.9), (1, 0.6), (2, 0.6), (2, 0.4), (3, 0.3)]
    df = spark.createDataFrame(rows, "entity_id long, confidence double")
    got = sorted((r.entity_id, r.confidence) for r in gather.confident_values(df, 0.7, 0.5, 1).collect())
    assert got == [(1, 0.9), (2, 0.6)]


def test_impute_fills_only_gaps_and_names_the_source(spark):
    target = spark.createDataFrame([(7, 1, None, "kept"), (8, 1, "own", None), (9, 2, None, None)], "id long, entity_id long, a string, b string")
    fused = spark.createDataFrame([(1, "a", "A", 0.9, "u")], "entity_id long, field string, value string, confidence double, source_url string")
    got = {r.id: (r.a, r.a_source, r.b, r.b_source) for r in gather.impute(target, fused, ["a", "b"]).collect()}
    assert got == {7: ("A", "u", "kept", None), 8: ("own", None, None, None), 9: (None, None, None, None)}


# --- accounting ------------------------------------------------------------------------------


def test_costs_and_tokens(spark):
    rows = [({"total_cost": 2.0, "cost": 1.0},), ({"cost": 1.0},), ({},), (None,)]
    assert one(spark, rows, "u map<string,double>", usage.extract_cost(F.col("u"))) == [2.0, 1.0, 0.0, 0.0]
    stages = [([("f", 100, 40), ("p", 40, 10)],), ([("f", 0, 5)],), ([],)]
    got = one(spark, stages, "s array<struct<stage:string,input:long,output:long>>", usage.overall_reduction(F.col("s")))
    assert got == [90.0, 0.0, None]


def test_status_texts(spark):
    c = F.col
    schema = "status string, done boolean, a int, b int, x int, f int, n int, e int"
    rows = [
        ("initializing", False, 0, 0, 0, 0, 0, 0), ("running", False, 0, 0, 0, 0, 0, 0), ("running", True, 2, 1, 3, 1, 9, 0),
        ("running", True, 0, 0, 3, 0, 9, 0), ("finished", True, 0, 0, 3, 0, 9, 0), ("failed", True, 0, 0, 0, 4, 9, 2),
        ("cancelled", True, 0, 0, 1, 0, 9, 0), ("paused", True, 0, 0, 1, 0, 9, 0),
    ]
    text = usage.status_text(c("status"), c("done"), c("a"), c("b"), c("x"), c("f"), c("n"), c("e"))
    assert one(spark, rows, schema, text) == [
        "Initializing pipeline...", "Searching for URLs...", "2 scraping, 1 extracting | 3 extracted, 1 failed of 9",
        "Processing... | 3 extracted of 9", "Finished: 3/9 successful extractions", "Failed: 0/9 completed, 2 errors",
        "Cancelled: 1/9 completed before cancellation", "Status: paused",
    ]


def test_instants(spark):
    rows = [("2025-01-01T00:00:00Z",), ("2025-01-01T02:00:00+02:00",), ('["2024-01-01T00:00:00Z","2025-01-01T00:00:00Z"]',), ("soon",), (None,)]
    got = one(spark, rows, "t string", F.unix_seconds(timing.parse_instant(F.col("t"))))
    assert got == [1735689600] * 3 + [None, None]


def test_single_value_has_no_deviation(spark):
    df = spark.createDataFrame([("total_scrape_time", 31.0)], "phase string, seconds double")
    row = timing.slow_phases(
        df.groupBy("phase").agg(F.count("*").alias("n"), F.max("seconds").alias("max"), F.avg("seconds").alias("avg"))
    ).first()
    assert (row.concern_level, row.threshold) == ("high", 10.0)


def test_vendor_file(spark, tmp_path):
    (tmp_path / "v.json").write_text(
        """[{"part_number": "R1", "price": "1 : $58.90000 : Bulk;10 : $1,055.95500 : Reel", "stock": "In-Stock: 1,049",
        "lead_time": "10 Weeks", "load_current": "20 A", "voltage_input": "3 ~ 32VDC", "voltage_load": "240V",
        "documents_and_media": [{"type": "Video File", "link": []}, {"type": "Datasheets", "link": ["http://x"]}],
        "product_attributes": [{"type": "Series", "description": "RGC"}, {"type": "Series", "description": "RGD"}]},
        {"part_number": "R2", "price": null, "product_attributes": [], "documents_and_media": []}]"""
    )
    rows = vendor.read_rows(spark, str(tmp_path))
    ladder = [(r.quantity, r.unit_price, r.packaging) for r in vendor.price_ladder(rows).orderBy("step").collect()]
    assert ladder == [(1, 58.9, "Bulk"), (10, 1055.955, "Reel")]
    q = {r.part_number: r for r in vendor.quantities(rows).collect()}
    assert (q["R1"].in_stock, q["R1"].lead_days, q["R1"].input_volts_low, q["R1"].input_volts_high) == (1049, 70, 3.0, 32.0)
    assert (q["R1"].load_volts_low, q["R1"].load_volts_high, q["R2"].in_stock) == (240.0, 240.0, None)
    links = {(r.part_number, r.type, r.link) for r in vendor.media_links(rows).collect()}
    assert links == {("R1", "Video File", None), ("R1", "Datasheets", "http://x"), ("R2", None, None)}
    assert [r.series for r in vendor.attribute_columns(rows, ["Series"]).orderBy("part_number").collect()] == ["RGD", None]
