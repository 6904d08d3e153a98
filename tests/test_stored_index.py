"""Searches of a written index: as an exhaustive search, without reading texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from gapweave.operators import stored_index
from gapweave.session import scratch_dir


def brute(queries, corpus, n_docs, k):
    cut = {(c, d): Counter(w for w in re.split(r"[\W_]+", (t or "").lower()) if w) for c, d, t in corpus}
    df = Counter((c, w) for (c, _), words in cut.items() for w in words)
    out = set()
    for entity, name in queries:
        words = {w for w in re.split(r"[\W_]+", (name or "").lower()) if w}
        for channel in {c for c, _ in cut}:
            scored = []
            for (c, d), counts in cut.items():
                if c == channel and words & counts.keys():
                    score = sum(counts[w] * math.log((n_docs + 1) / (df[c, w] + 1)) for w in words & counts.keys())
                    scored.append((-round(score, 6), d))
            out |= {(entity, channel, d, r + 1, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [("body", d, " ".join(rng.choices(words, [1 / (i + 1) for i in range(200)], k=rng.randrange(0, 60)))) for d in range(600)]
    rows += [("title", d, rng.choice(words)) for d in range(0, 600, 7)]
    return [*rows, ("body", 900, None), ("body", 901, ""), ("body", 902, "w0 " * 500)]


@pytest.fixture(scope="module")
def index(spark, corpus):
    df = spark.createDataFrame(corpus, "channel string, doc_id long, text string")
    return stored_index.build(df, 603, scratch_dir(spark))


def test_as_an_exhaustive_search(spark, corpus, index):
    rng = random.Random(7)
    queries = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    queries += [(100, None), (101, "###"), (102, "w0 w1 W2"), (103, "unknown w150")]
    got = stored_index.search(spark.createDataFrame(queries, "entity_id long, name string"), index, 5)
    rows = {(r.entity_id, r.channel, r.doc_id, r.channel_rank, r.score) for r in got.collect()}
    assert {r[:4] for r in rows} == {r[:4] for r in brute(queries, corpus, 603, 5)}
    scores = {r[:3]: r[4] for r in brute(queries, corpus, 603, 5)}
    assert all(abs(scores[r[:3]] - r[4]) < 2e-6 for r in rows)


def test_a_search_reads_no_text_and_shuffles_no_table(spark, index):
    queries = spark.createDataFrame([(1, "w3 w40")], "entity_id long, name string")
    plan = stored_index.search(queries, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and plan.count("Bucketed: true") >= 3


def test_a_search_looks_no_word_up_in_rows_and_moves_no_vector(spark, index):
    """A document's counts are unpacked once for all its queries, and stay in their bucket."""
    queries = spark.createDataFrame([(1, "w3 w40")], "entity_id long, name string")
    with_joins = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in with_joins}
    try:
        for key, value in with_joins.items():
            spark.conf.set(key, value)
        plan = stored_index.search(queries, index, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    lines = plan.splitlines()
    assert "lambda" not in plan and any("MapInArrow" in line for line in lines)
    at = next(i for i, line in enumerate(lines) if "_vectors[" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    above = []  # from the scan of the vectors up to the first join
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-"))
        if here < depth:
            depth = here
            above.append(line)
            if "Join" in line:
                break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above)


@pytest.mark.parametrize("size", [1, 7, 128, 1000])
def test_blocks_are_cut_across_batches(size):
    rng = random.Random(size)
    rows = sorted((c, f"w{rng.randrange(6) ** 2}", -rng.randrange(1, 5), d) for c in ("a", "b") for d in range(1500))
    columns = {"channel": [r[0] for r in rows], "word": [r[1] for r in rows], "doc_id": [r[3] for r in rows]}
    table = pa.table({**columns, "tf": pa.array([-r[2] for r in rows], pa.int32())})
    got = [b for batch in stored_index._cut_blocks(iter(table.to_batches(max_chunksize=size))) for b in batch.to_pylist()]
    postings = [(b["channel"], b["word"], -tf, d) for b in got for d, tf in zip(b["docs"], b["tfs"])]
    assert postings == rows and all(b["n"] == len(b["docs"]) and b["max_tf"] == b["tfs"][0] for b in got)
    per_word = Counter((r[0], r[1]) for r in rows)
    assert Counter((b["channel"], b["word"]) for b in got) == {w: -(-n // stored_index.BLOCK) for w, n in per_word.items()}


def test_blocks_are_in_order_of_impact(index):
    blocks = index.blocks.collect()
    assert all(b.n == len(b.docs) == len(b.tfs) <= stored_index.BLOCK and b.max_tf == b.tfs[0] and list(b.tfs) == sorted(b.tfs, reverse=True) for b in blocks)
    per_word = Counter()
    for b in blocks:
        per_word[b.channel, b.word] += b.n
    assert per_word == {(r.channel, r.word): r.df for r in index.words.collect()}


def test_most_blocks_of_a_frequent_word_stay_closed(spark):
    rows = [("body", d, "rare " * (d < 20) * 9 + "often " * (1 + d % 40 // 39) + f"own{d}") for d in range(4000)]
    index = stored_index.build(spark.createDataFrame(rows, "channel string, doc_id long, text string"), 4000, scratch_dir(spark))
    got = stored_index.search(spark.createDataFrame([(1, "rare often")], "entity_id long, name string"), index, 10)
    assert {r.doc_id for r in got.collect()} <= set(range(20))
    assert index.blocks.filter("word = 'often'").count() > 30 and index.blocks.filter("word = 'often' AND max_tf > 1").count() < 6


def test_an_index_is_found_again(spark, index, corpus):
    path = scratch_dir(spark)
    made = stored_index.build(spark.createDataFrame(corpus[:50], "channel string, doc_id long, text string"), 50, path)
    queries = spark.createDataFrame([(1, "w0 w1")], "entity_id long, name string")
    again = stored_index.read(spark, path)
    assert again.n_docs == 50 and stored_index.search(queries, again, 3).collect() == stored_index.search(queries, made, 3).collect()
