"""Hot groups, equal results of alternative ways, and the plans Spark makes."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gapweave import catalog
from gapweave.config import MODE_ONLY, FastPath, Field, RunConfig
from gapweave.operators import gather, hits, metrics, running, search
from gapweave.plans import jobs

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows belong to run 0; instants repeat."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        run = 0 if i % 3 == 0 else rng.randrange(1, 40)
        rows.append((run, i, rng.randrange(0, 6000), rng.randrange(0, 50) / 100))
    df = spark.createDataFrame(rows, "run_id long, event_id long, second long, cost double")
    df = df.withColumn("ts", F.timestamp_seconds("second")).withColumn("url", F.format_string("u%05d", "event_id"))
    return rows, df.drop("second")


@pytest.fixture(params=[1, 4, 50])
def ways(request, spark):
    """Groups in one range, in several, and with a few rows in each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def by_run(rows):
    groups = defaultdict(list)
    for run, event, second, cost in rows:
        groups[run].append((second, event, cost))
    return {k: sorted(v) for k, v in groups.items()}


def test_running_cost_equals_brute_force(skewed, ways):
    rows, df = skewed
    want = {}
    for items in by_run(rows).values():
        total, cut = 0, False
        for _, event, cost in items:
            total += round(cost * 100)
            over = total > 500
            want[event] = (total / 100, over, over and not cut)
            cut = cut or over
    got = {r.event_id: (r.running_cost, r.over_budget, r.is_cut) for r in metrics.running_cost(df, 5.0).collect()}
    assert got == want


def test_gaps_equal_brute_force(skewed, ways):
    rows, df = skewed
    want = {}
    for items in by_run(rows).values():
        before = None
        for second, event, _ in items:
            want[event] = None if before is None else float(second - before)
            before = second
    assert {r.event_id: r.gap_seconds for r in metrics.event_gaps(df).collect()} == want


def test_row_numbers_over_many_slices(spark, ways):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") + 1).alias("rank"))
    done = running.row_numbers(df, ["g"], ["rank"], "pos").collect()
    assert all(r.pos == (r["rank"] + 1) // 2 if r.g == 0 else r.pos == r["rank"] // 2 for r in done)


def test_null_keys_null_values_and_one_hot_instant(spark, ways):
    rng = random.Random(5)
    rows = [(None if i % 3 == 0 else i % 5, 7 if i % 2 else rng.randrange(20), i, None if i % 4 == 0 else rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g long, at long, id long, v long")
    groups = defaultdict(list)
    for g, at, i, v in rows:
        groups[g].append((at, i, v))
    sums, before, most, number = {}, {}, {}, {}
    for items in groups.values():
        total, last, top = 0, None, None
        for n, (_, i, v) in enumerate(sorted(items, key=lambda r: r[:2])):
            total += v or 0
            top = v if top is None else top if v is None else max(top, v)
            sums[i], before[i], most[i], number[i] = total, last, top, n + 1
            last = v
    order = ["at", "id"]
    assert {r.id: r.s for r in running.running_sums(df, ["g"], order, {"s": F.coalesce("v", F.lit(0))}).collect()} == sums
    assert {r.id: r.p for r in running.previous_value(df, ["g"], order, "v", "p").collect()} == before
    assert {r.id: r.m for r in running.running_max(df, ["g"], order, "v", "m").collect()} == most
    assert {r.id: r.n for r in running.row_numbers(df, ["g"], order, "n").collect()} == number


def test_cost_rank_equals_brute_force(skewed, ways):
    rows, df = skewed
    got = {r.url: (r["rank"], r.dense_rank) for r in metrics.cost_rank(df.withColumnRenamed("run_id", "entity_id")).collect()}
    for items in by_run(rows).values():
        costs = [c for _, _, c in items]
        for _, event, cost in items:
            want = (1 + sum(c > cost for c in costs), 1 + len({c for c in costs if c > cost}))
            assert got[f"u{event:05d}"] == want


def test_cached_answers_equal_brute_force(spark, ways):
    rng = random.Random(3)
    asked = [(i, "hot" if i % 3 else f"q{i % 7}", 10, rng.randrange(0, 40000)) for i in range(600)]
    known = [("hot" if i % 2 else f"q{i % 7}", 10, rng.randrange(0, 40000)) for i in range(40)]
    requests = spark.createDataFrame(asked, "id long, query string, top_k int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    cache = spark.createDataFrame(known, "query string, top_k int, s long").withColumn("cached_at", F.timestamp_seconds("s")).drop("s")
    want = {i for i, q, k, s in asked if not any(q == cq and k == ck and 0 <= s - cs <= 3600 for cq, ck, cs in known)}
    assert {r.id for r in hits.uncached_requests(requests, cache, 3600).collect()} == want
    assert 0 < len(want) < 600


def test_first_per_link_keeps_the_earliest_of_many_copies(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("entity_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 50)).alias("link"),
        (5000 - F.col("id")).alias("pos"),
    )
    got = {r.link: r.pos for r in hits.first_per_link(df).collect()}
    want = {}
    for i in range(3000):
        link = "hot" if i % 3 == 0 else f"l{i % 50}"
        want[link] = min(want.get(link, 10**9), 5000 - i)
    assert got == want


def test_fuse_with_a_hot_value(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("entity_id"), F.lit("f").alias("field"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("value"),
        F.lit(0.5).alias("confidence"), F.col("id").cast("string").alias("url"),
    )
    r = gather.fuse(df).first()
    assert (r.value, r.votes, r.source_url) == ("hot", 1000, "0")


# --- search -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = {i: rng.choices(vocabulary, weights, k=rng.choice([5, 30, 200])) for i in range(400)}
    queries = {i: rng.choices(vocabulary, k=8) + ["w0", "unknown"] for i in range(25)}
    return docs, queries


def test_search_equals_brute_force(spark, texts):
    docs, queries = texts
    tf = {d: Counter(w) for d, w in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    want = {}
    for q, words in queries.items():
        scores = {}
        for d, counts in tf.items():
            shared = [w for w in set(words) if w in counts]
            if shared:
                scores[d] = round(sum(counts[w] * math.log((len(docs) + 1) / (df[w] + 1)) for w in shared), 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7]
        want.update({(q, r + 1): d for r, (d, _) in enumerate(best)})
    corpus = spark.createDataFrame([("body", d, " ".join(w).upper()) for d, w in docs.items()], "channel string, doc_id long, text string")
    asked = spark.createDataFrame([(q, ", ".join(w)) for q, w in queries.items()], "entity_id long, name string")
    found = search.search(asked, corpus, len(docs), 7)
    assert {(r.entity_id, r.channel_rank): r.doc_id for r in found.collect()} == want


def test_pruning_leaves_most_pairs_out(spark, texts):
    docs, queries = texts
    corpus = spark.createDataFrame([("body", d, " ".join(w)) for d, w in docs.items()], "channel string, doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(w)) for q, w in queries.items()], "entity_id long, name string")
    words, found = search.postings(asked, corpus)
    weights = found.groupBy("channel", "word").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
    terms = words.join(weights.withColumn("idf", F.log(F.lit(401.0) / (F.col("df") + 1))), "word")
    everything = found.join(terms, ["channel", "word"]).select(*search.PAIR).distinct().count()
    assert search._candidates(found, terms, 10, 3).count() < everything / 2


def test_wordless_queries_find_nothing(spark):
    corpus = spark.createDataFrame([("body", 1, "a b")], "channel string, doc_id long, text string")
    asked = spark.createDataFrame([(1, "### ?!"), (2, "")], "entity_id long, name string")
    assert search.search(asked, corpus, 1, 5).count() == 0


# --- plans --------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("x", "job1", "job2", "job5", "job8", "job9", "s5", "s6", "s7", "s9"))])
def test_no_query_multiplies_rows_or_leaves_the_jvm(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = re.search(r"PythonUDF|MapInPandas|ArrowEvalPython|BatchEvalPython", plan)
    assert bool(python) == (name in ("u1_extractor_hook", "u4_fetcher_hook", "u4_stored_pages", "j9_keyword_table"))


def test_rank_filters_are_cut_before_the_shuffle(spark, folder):
    for name in ("w3_select_links", "w3_trim_channels", "t2_first_results", "r1_search_documents"):
        assert "Partial" in plan_of(QUERIES[name](spark, folder)).split("WindowGroupLimit", 1)[1]


def test_pairs_of_a_search_reach_no_shuffle(spark, folder):
    """Only postings are dealt out by document; a query's words are looked up where they are."""
    for name in ("r1_search_documents", "r1_search_pages", "r3_search_links"):
        plan = plan_of(QUERIES[name](spark, folder))
        assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, \d+\), REPARTITION_BY", plan)) == 1


@pytest.mark.parametrize("meetings", [1, 7, 4_000_000])
def test_searches_in_place_and_by_candidates_agree(spark, monkeypatch, meetings):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    docs = [(c, i, " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(80) for c in ("title", "body")]
    docs += [("body", 100 + i, "w1 w2 w3") for i in range(9)]  # ties
    corpus = spark.createDataFrame(docs, "channel string, doc_id long, text string")
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(20)] + [(90, "rare"), (91, "###"), (92, "w1 rare")]
    queries = spark.createDataFrame(asked, "entity_id long, name string")
    columns = ["entity_id", "channel", "doc_id", "channel_rank", "score"]
    monkeypatch.setattr(search, "TASK_MEETINGS", meetings)
    in_place = sorted(tuple(r) for r in search.search(queries, corpus, 89, 4).select(*columns).collect())
    monkeypatch.setattr(search, "MAX_BROADCAST_WORDS", 0)
    assert in_place == sorted(tuple(r) for r in search.search(queries, corpus, 89, 4).select(*columns).collect())
    assert len(in_place) > 100


def test_many_meetings_are_searched_by_likely_pairs(spark, monkeypatch):
    """Queries and documents that meet in common words: the same answers, also in parts of the queries, and few pairs of them scored."""
    rng = random.Random(6)
    docs = [("body", i, " ".join(["common"] * rng.randrange(1, 60) + [f"w{min(int(rng.paretovariate(0.7)), 30)}" for _ in range(rng.randrange(1, 40))])) for i in range(300)]
    corpus = spark.createDataFrame(docs + [("title", i, f"common w{i % 7}") for i in range(300)], "channel string, doc_id long, text string")
    queries = spark.createDataFrame([(i, f"common w{i % 25} w{i % 19}") for i in range(60)], "entity_id long, name string")
    columns = ["entity_id", "channel", "doc_id", "channel_rank", "score"]
    in_place = sorted(tuple(r) for r in search.search(queries, corpus, 300, 4).select(*columns).collect())
    monkeypatch.setattr(search, "MOST_MEETINGS", 0)
    before = spark.conf.get(search.BY_SOME_KEYS, "true")
    for words in (1000, 100):
        monkeypatch.setattr(search, "PART_WORDS", words)
        assert in_place == sorted(tuple(r) for r in search.search(queries, corpus, 300, 4).select(*columns).collect())
    assert spark.conf.get(search.BY_SOME_KEYS, "true") == before
    assert len(in_place) > 300


def test_equal_queries_are_searched_once(spark, monkeypatch):
    """A thousand entities that ask the same words cost one search, whatever the order of the words."""
    corpus = spark.createDataFrame([("body", i, f"red bolt n{i}") for i in range(20)], "channel string, doc_id long, text string")
    names = ["red bolt", "Bolt, red red", "n3", "###", None]
    queries = spark.createDataFrame([(i, names[i % 5]) for i in range(1000)], "entity_id long, name string")
    asked = []
    one = search.postings
    monkeypatch.setattr(search, "postings", lambda q, c: asked.append(q.count()) or one(q, c))
    got = Counter(r.entity_id % 5 for r in search.search(queries, corpus, 20, 4).collect())
    assert asked == [2]
    assert got == {0: 800, 1: 800, 2: 200}


def test_vendor_answers_are_read_once(spark, folder, monkeypatch):
    """However many entities ask for an answer, its body is read in its own row and goes no further."""
    answers = spark.createDataFrame([("https://www.digikey.com/en/products/result?keywords=" + n, True, '{"part": "p"}', "json", None) for n in "ab"],
                                    "url string, success boolean, data string, data_kind string, error string")
    entities = spark.createDataFrame([(i, "abc"[i % 3], None, None) for i in range(300)], "entity_id long, name string, identifier_context string, impute_task_purpose string")
    config = RunConfig(fast_path=FastPath(mode=MODE_ONLY))
    read = []
    write = jobs.hand_over
    monkeypatch.setattr(jobs, "hand_over", lambda df: read.append(df.count()) or write(df))
    results = jobs.fast_results(entities, answers, [Field("part", "the part")], config)
    assert read == [2]
    assert Counter(r.content["part"][0] for r in results.collect()) == {"p": 200}
    plan = plan_of(jobs.fast_path(entities, answers, config))
    assert re.search(r"Exchange hashpartitioning\(entity_id#\d+L, \d+\), REPARTITION_BY_NUM", plan)


def test_scans_read_only_what_is_used(spark, folder):
    plan = plan_of(QUERIES["a3_costs_by_url"](spark, folder))
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan
    plan = plan_of(QUERIES["w2_interleave"](spark, folder))
    assert "html" not in plan
    plan = plan_of(QUERIES["a8_stage_counters"](spark, folder))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


def test_strategies_are_scored_in_the_row_of_the_page(spark, folder):
    plan = plan_of(QUERIES["a20_strategy_scores"](spark, folder))
    assert plan.count("FileScan parquet") == 1 and "hashpartitioning" not in plan and "Join" not in plan


def test_links_need_no_titles(spark, folder):
    plan = plan_of(QUERIES["r3_search_links"](spark, folder))
    assert "html:string" not in plan and "<title>" not in plan
