from __future__ import annotations

import zlib

from gapweave.llm import shards


def brute(rows, n):
    listed = sorted(
        ((i is not None, i or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    total, before, out, slots = sum(r[1] for r in listed), 0, [], [0] * n
    for (some, i), size, crc in listed:
        k = min(int((before + size / 2) * n // total), n - 1)
        out.append((i if some else None, size, crc, k, slots[k]))
        slots[k] += 1
        before += size
    return out


def check(got, rows, n):
    # equal rows may stand in any order
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, n)))


def result(df):
    return [tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = result(shards.op5(spark, folder))
    check(got, rows, 8)
    sizes = [sum(r[1] for r in got if r[3] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_nulls_ties_repeats_and_clashing_columns(make_docs, clashing):
    rows = [(None, None), (None, "é"), (1, ""), (1, ""), (1, "a"), (2, "b" * 5000), *[(7, "same")] * 40, (3, None)]
    check(result(shards.balanced_shards(clashing(make_docs(rows)), 4)), rows, 4)


def test_no_rows(make_docs):
    assert result(shards.balanced_shards(make_docs([]))) == []


def test_one_shard_and_more_shards_than_rows(make_docs):
    rows = [(1, "a"), (2, "bb")]
    for n in (1, 50):
        check(result(shards.balanced_shards(make_docs(rows), n)), rows, n)
