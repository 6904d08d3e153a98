"""Manifests and proofs against a tree built level by level in plain Python."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from gapweave.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.COLUMNS])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    for rs in langs.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in langs[k]]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    for n, k in enumerate(order):
        for i, r in enumerate(langs[k]):
            proof = [*path(trees[k], i), *path(top, n)]
            altered = dict(r)
            if r["text"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                altered["text"] = r["text"].translate(str.maketrans(merkle.UPPER, merkle.UPPER.lower()))
            folded = leaf(altered)
            for left, right in proof:
                folded = h(*left, folded, *right)
            beside = h(*[s for left, right in proof for s in left + right])
            yield (r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], beside, folded, folded == top[-1][0])


def same(docs):
    rows = [r.asDict() for r in docs.collect()]
    got = [tuple(r) for r in merkle.audit(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "Ab", "x", "s", 2)],
        [(i, f"A{i}", None if i == 0 else "x", None, i) for i in range(3)],
        # null, repeated and equal rows, 31 keys of 1 to over 1000 rows, empty texts
        [(i // 2 or None, f"A{i // 3}é" if i % 5 else "", None if i % 70 == 0 else f"l{min(i % 300, 30)}", "s", None) for i in range(1300)],
        # more keys than a stored level spans
        [(i, None if i % 2 else "B", f"k{i}", "s", 1) for i in range(70)],
    ],
)
def test_against_brute_force(spark, rows):
    same(spark.createDataFrame(rows, DOCS))


def test_altered_rows_are_found(spark, folder):
    got = same(spark.read.parquet(f"{folder}/documents.parquet"))
    assert {r[-1] for r in got} == {True, False}


def test_other_columns_do_not_matter(spark, make_docs, clashing):
    docs = make_docs([(1, "A b"), (2, "C"), (3, None), (3, None), (4, "x" * 3_000_000)])
    names = "idx n node g proof root leaf subroot _key _range".split()
    more = clashing(docs).select("*", *[F.lit("y").alias(n) for n in names if n not in clashing(docs).columns])
    assert sorted(merkle.audit(more).collect(), key=str) == sorted(merkle.audit(docs).collect(), key=str)


def test_only_every_second_level_is_stored(spark):
    leaves = spark.range(0, 5000).select(F.lit("k").alias("k"), F.col("id").alias("idx"), F.lit(5000).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    levels = merkle.stored_levels(leaves, ["k"])
    assert [lv.count() for lv in levels] == [5000, 79, 2, 1]
    expected = tree([h(str(i)) for i in range(5000)])
    assert levels[-1].first().node == expected[-1][0]
    assert [r.node for r in levels[1].orderBy("idx").collect()] == expected[2]
