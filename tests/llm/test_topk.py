from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import topk


def brute(rows, k=10, step=100):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.setdefault((i, tuple(math.floor(1024 * np.float32(x).astype(float)) for x in v)))
    out = []
    for qi, q in kept:
        if qi % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in kept if i != qi and len(v) == len(q))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    vectors = topk.quantised(df)
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.filter("vec_id % 100 = 0")).collect())


def rows(n=700, dims=6):
    rng = random.Random(1)
    out = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.125, 0.5, 1.0]) for _ in range(dims)]) for i in range(n)]
    out[5] = (5, None)
    out[6] = (6, [None] * dims)
    out[7] = (7, [math.nan] + [0.0] * (dims - 1))
    out[8] = (8, [math.inf] * dims)
    out += [out[100], out[11], (None, [1.0] * dims), (800, [1.0]), (801, [2.0]), (900, []), (901, []), (1000, [0.0] * dims)]
    return out


@pytest.mark.parametrize("candidates,queries", [(4096, 1024), (64, 3)])
def test_against_brute_force(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", queries)
    assert result(spark, rows()) == brute(rows())


def test_no_rows_and_few_rows(spark):
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 2048 * 1024)]


def test_lists_stop_early():
    ids = np.arange(5000)
    vectors = np.random.default_rng(0).integers(-100, 100, (5000, 3))
    vectors[77] = 5000
    lists = topk.SortedLists(ids, vectors)
    met = []
    lists.vectors = type("Counting", (np.ndarray,), {"__getitem__": lambda s, k: (met.append(np.size(k)), np.ndarray.__getitem__(s, k))[1]})(
        lists.vectors.shape, lists.vectors.dtype, lists.vectors.copy()
    )
    best, scores = lists.best(np.array([1, 1, 1]), -1, 1)
    assert best.tolist() == [77] and scores.tolist() == [15000]
    assert sum(met) < 500
