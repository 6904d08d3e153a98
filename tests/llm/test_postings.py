from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gapweave.llm import postings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, t in items:
            own = words(t)
            n = min(width, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(map(str, out))


def result(df):
    return sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in df.collect())


LONG = " ".join(f"w{i % 97}x{i // 97}" for i in range(30_000))
ITEM_ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "the the the the the the the the the the the"),
    (3, "short one"),
    (3, "short one"),
    (4, None),
    (5, "... !!"),
    (6, "École Éa b2"),
    (7, " ".join(f"w{i}x5" for i in range(20, 40))),
    (10, "the"),
]
DOC_ROWS = [
    (1, "ALPHA, beta gamma-delta epsilon zeta eta theta iota kappa!"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota. Lambda mu"),
    (3, "THE the the the the the the the the the the the end"),
    (4, "a SHORT one; short one short"),
    (5, "École Éa B2 and école éa b2"),
    (6, None),
    (7, ""),
    (8, "..."),
    (9, LONG),
    (9, "the"),
    (9, "the"),
    (None, "x short one"),
    (None, "nothing"),
    (11, "...lead short\tone"),
    (12, "mu lambda kappa iota theta eta zeta epsilon delta gamma beta alpha"),
]


def test_against_brute_force(spark, make_docs, clashing):
    got = postings.contamination(clashing(make_docs(DOC_ROWS)), spark.createDataFrame(ITEM_ROWS, ITEMS))
    assert result(got) == brute(DOC_ROWS, ITEM_ROWS)


@pytest.mark.parametrize("docs,items", [([], ITEM_ROWS), (DOC_ROWS[:4], []), ([], [])])
def test_empty_tables(spark, make_docs, docs, items):
    got = postings.contamination(make_docs(docs), spark.createDataFrame(items, ITEMS))
    assert result(got) == brute(docs, items)


def test_shuffled_joins_give_the_same(spark, make_docs, monkeypatch):
    monkeypatch.setattr(postings, "BROADCAST_ROWS", -1)
    got = postings.contamination(make_docs(DOC_ROWS), spark.createDataFrame(ITEM_ROWS, ITEMS))
    assert result(got) == brute(DOC_ROWS, ITEM_ROWS)


def test_leaks_go(spark, make_docs):
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    kept = postings.without_leaks(make_docs(DOC_ROWS), items)
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(
        str((d, t)) for d, t in DOC_ROWS if not eval(brute([(d, t)], ITEM_ROWS)[0])[2]
    )


def test_proximity(spark, make_docs):
    items = postings.item_windows(spark.createDataFrame([(1, "red orange yellow green blue indigo violet")], ITEMS))
    docs = make_docs([(1, "red orange yellow green blue indigo violet"), (2, "yellow then red orange green"), (3, "blue " + "x " * 30 + "red")])
    index = postings.build_index(docs, items)
    near = {r.doc_id: r.spread for r in postings.proximity_matches(index, items, slop=5).collect()}
    assert near[1] == 0 and 3 not in near


def test_no_python_in_the_plan(spark, folder):
    plan = postings.op10(spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_proximity_of_repeated_terms(spark, make_docs):
    rng = random.Random(9)
    own = ["red", "orange", "yellow"]
    rows = [(i, " ".join(rng.choice([*own, "x", "x"]) for _ in range(rng.randrange(3, 30)))) for i in range(200)]
    # starts 0 and 4 of one term, 5 and 6 of the others
    rows.append((500, "red x x x red x orange x yellow"))
    items = postings.item_windows(spark.createDataFrame([(1, " ".join(own))], ITEMS))
    got = postings.proximity_matches(postings.build_index(make_docs(rows), items), items, slop=5)
    expected = set()
    for i, t in rows:
        starts = [(k - own.index(w), w) for k, w in enumerate(t.split()) if w in own]
        for s, _ in starts:
            first = [min((b for b, w in starts if w == o and s <= b <= s + 5), default=None) for o in own]
            if None not in first:
                expected.add((i, s, max(first) - s))
    assert {(r.doc_id, r.start, r.spread) for r in got.collect()} == expected
