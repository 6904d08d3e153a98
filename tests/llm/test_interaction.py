"""Filter interactions against plain loops over all orders, whatever the order of the files."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from gapweave.llm import interaction

DOCS = "doc_id long, text string, source string, mask string, digest string, bucket string"
LABELS = "doc_id long, quality int, toxic int, good string"


def brute(rows, labels):
    marks = {}
    for doc_id, quality, toxic in labels:
        mark = marks.setdefault(doc_id, [False, False])
        mark[0] |= quality == 1
        mark[1] |= toxic == 1
    place = lambda d: 2**63 - 1 if d is None else d
    least = {}
    for doc_id, text, _ in rows:
        least[text or ""] = min(least.get(text or "", 2**64), place(doc_id))
    parts = {}
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        failed = [
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)),
            least[text] < place(doc_id),
        ]
        letters = "".join(f for f, x in zip("ABCDE", failed) if x)
        good, toxic = marks.get(doc_id, (False, False)) if doc_id is not None else (False, False)
        parts.setdefault(source or "", []).append((letters, good, toxic))
    for part, docs in parts.items():
        found, shapley = {}, dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                fails = sum(f in d[0] for d in docs)
                alone = sum(d[0] == f for d in docs)
                found[order, k + 1] = (len(left), len(gone), fails - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone))
        for (order, step), counts in found.items():
            yield (part, order, step, *counts, shapley[order[step - 1]])


def run(spark, path, rows, labels, files, batches, in_memory=interaction.IN_MEMORY):
    for n in range(files):
        spark.createDataFrame([(*r, "x", "y", "z") for r in rows[n::files]], DOCS).coalesce(1).write.mode("append").parquet(f"{path}/documents.parquet")
    marks = spark.createDataFrame([(*r, "w") for r in labels], LABELS)
    return interaction.counters(spark, f"{path}/documents.parquet", marks, batches, in_memory)


@pytest.mark.parametrize(("batches", "in_memory"), [(1, interaction.IN_MEMORY), (6, interaction.IN_MEMORY), (6, 0)])
def test_against_brute_force(spark, tmp_path, batches, in_memory):
    rng = random.Random(batches)
    words = ["a", "B", "#x", "word", "CAPS", "é", "\x85", "two\tthree"]
    texts = [None, ""] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(30)]
    # many copies, repeated and null ids, smaller ids after larger ones
    rows = [(rng.choice([None, 2**60, *range(200)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(500)]
    rows.append((1000, "Z %" * 2_000_000, "long"))
    labels = [(i // 2 if i % 9 else None, i % 3 % 2, 1 if i % 5 == 0 else None) for i in range(400)]
    got = interaction.interactions(run(spark, tmp_path, rows, labels, 6, batches, in_memory))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, labels))


def test_a_smaller_id_takes_back_what_was_counted(spark, tmp_path):
    rows = [(9, "t", "a"), (7, "t", "b"), (3, "t", "c"), (5, "t", "d")]
    got = run(spark, tmp_path, rows, [(7, 1, 0)], 4, 4).collect()
    copies = 1 + interaction.COPY
    assert {(r.part, r["mask"], r.good): r.n for r in got} == {("a", copies, False): 1, ("b", copies, True): 1, ("c", 1, False): 1, ("d", copies, False): 1}


def test_state_of_a_text():
    first, late = interaction._met(None, 5, [["a", False, False, 3, 1], ["b", False, False, 1, 1]])
    assert first == [5, [["a", False, False, 1], ["b", False, False, 1]]] and late == [["a", False, False, 2]]
    same, late = interaction._met(first, 8, [["c", False, False, 2, 2]])
    assert same == first and late == [["c", False, False, 2]]
    same, late = interaction._met(first, 5, [["a", False, False, 2, 1]])
    assert same == [5, [["a", False, False, 2], ["b", False, False, 1]]] and late == [["a", False, False, 1]]
    less, late = interaction._met(first, 2, [["c", True, False, 2, 1]])
    assert less == [2, [["c", True, False, 1]]] and late == [*first[1], ["c", True, False, 1]]


def test_empty_table(spark, tmp_path):
    assert interaction.interactions(run(spark, tmp_path, [], [], 1, 4)).collect() == []


def test_a_task_hands_on_a_row_for_each_text():
    import pyarrow as pa

    n = 3000
    batch = pa.RecordBatch.from_pydict(
        {
            "digest": ["0" * 32] * n,
            "doc_id": list(range(n, 0, -1)),
            "mask": [1] * n,
            "part": [f"s{i % 20}" for i in range(n)],
            "good": [False] * n,
            "toxic": [False] * n,
        }
    )
    (rows,) = interaction._gathered(8)(iter([batch]))
    texts = [r for r in rows.to_pylist() if r["digest"]]
    assert len(texts) == 1 and texts[0]["least"] == 1 and rows.num_rows == 21
