from __future__ import annotations

import random

import xxhash

from gapweave.llm import simhash
from gapweave.llm.components import smallest_reachable


def fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, prints[i], min(ids) if ids else None))
    return sorted(map(str, out))


def result(df):
    return sorted(str((r.doc_id, r.bits & (1 << 64) - 1, r.component_id)) for r in df.collect())


def near_copies():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(90000, None), (90001, ""), (90002, " \t"), (None, "one two"), (None, "one two"), (None, "lonely words here now")]
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 60, 400]))]
        for c in range(rng.choice([1, 1, 5, 12])):
            copy = base[:]
            for _ in range(c % 4):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 * (30 - k) + c, " ".join(copy).upper() if c % 2 else "  ".join(copy)))
    rows += rows[:8]
    return rows


def test_against_brute_force(make_docs, clashing):
    rows = near_copies()
    assert result(simhash.near_duplicates(clashing(make_docs(rows)))) == brute(rows)


def test_small_blocks_give_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 2)
    rows = near_copies()
    assert result(simhash.near_duplicates(make_docs(rows))) == brute(rows)


def test_no_rows(make_docs):
    assert result(simhash.near_duplicates(make_docs([]))) == []


def test_very_long_text():
    text = "a bc d " * 40_000
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_chain_keys_meet_for_every_pair_within_three_bits(spark):
    rng = random.Random(5)
    pairs = []
    for n in range(600):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    met = df.filter(F.arrays_overlap(simhash.chain_keys(F.col("a")), simhash.chain_keys(F.col("b"))))
    assert met.count() == len(pairs)
    linked = spark.createDataFrame([(x,) for p in pairs for x in p], "bits long").distinct()
    roots = {r.node: r.root for r in smallest_reachable(simhash.links(linked)).collect()}
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in pairs)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    got = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 40)}


def test_one_of_each_stays(make_docs):
    rows = near_copies()
    kept = sorted(r.doc_id for r in simhash.one_of_each(make_docs(rows)).collect() if r.doc_id is not None)
    import ast

    components = {ast.literal_eval(r)[2] for r in brute(rows)} - {None}
    assert kept == sorted(components)
