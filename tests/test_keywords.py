"""Keywords from a table against a nested loop."""

from __future__ import annotations

import random

from gapweave.operators import keywords


def brute(blocks, wanted):
    return {(u, p, f) for u, p, b in blocks for f, k in wanted if b and f is not None and k and k.strip() and k.strip().lower() in b.lower()}


def found(spark, blocks, wanted):
    b = spark.createDataFrame(blocks, "url string, pos int, block string")
    w = spark.createDataFrame(wanted, "field string, keyword string")
    rows = [tuple(r) for r in keywords.fields_in_blocks(b, w).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def samples(n):
    rng = random.Random(4)
    letters = "abAé ß"
    wanted = [(f"f{i % 300}", "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))) for i in range(n)]
    wanted += [(None, "a"), ("f", None), ("f", "  "), ("whole", "aba"), ("part", "ab")]
    blocks = [(f"u{i % 9}", i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    return [*blocks, ("u", 100, None), ("u", 101, ""), (None, None, "ABABA")], wanted


def test_ten_thousand_keywords_in_one_pass(spark):
    blocks, wanted = samples(10_000)
    assert found(spark, blocks, wanted) == brute(blocks, wanted)


def test_a_table_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(keywords, "PART_BYTES", 2000)
    blocks, wanted = samples(700)
    assert found(spark, blocks, wanted) == brute(blocks, wanted)


def test_no_keywords_and_no_blocks(spark):
    blocks, wanted = samples(5)
    assert found(spark, blocks, []) == set() == found(spark, [], wanted)


def test_blocks_are_not_shuffled(spark):
    b = spark.createDataFrame([("u", 1, "x")], "url string, pos int, block string")
    w = spark.createDataFrame([("f", "x")], "field string, keyword string")
    plan = keywords.fields_in_blocks(b, w)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
