from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gapweave.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"
LARGER = "/root/testdata/sf0.01"


def held_out_results(spark, query, label):
    got = query(spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
    assert got.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    return [(r[0], r[1]) for r in rows]


def test_quality_of_held_out_documents(spark):
    rows = held_out_results(spark, quality.op1, "quality")
    assert sum(a == b for a, b in rows) / len(rows) > 0.95
    assert all(a for a, b in rows if b) or sum(a for a, b in rows if b) / sum(b for _, b in rows) > 0.97


def test_toxicity_of_held_out_documents(spark):
    rows = held_out_results(spark, toxicity.op4, "toxic")
    assert sum(a == b for a, b in rows) / len(rows) > 0.9


CLEAN = "the quiet river runs past old stone houses near a small green hill"
INSULTS = ["moron", "idiot", "scoundrel", "blockhead"]


@pytest.fixture(scope="module")
def insulted():
    import random

    rng = random.Random(2)
    words = CLEAN.split() + [a + b for a in ("ba", "lo", "mi", "ther") for b in ("ran", "del", "tos", "nic", "on")]
    texts, labels = [], []
    for n in range(260):
        t = [rng.choice(words) for _ in range(40)]
        if n % 4 == 0:
            t[rng.randrange(40)] = INSULTS[n // 4 % 4]
        texts.append(" ".join(t).encode())
        labels.append(n % 4 == 0)
    return toxicity.fit_model(texts, labels)


@pytest.mark.parametrize("text", ["you idiot you", "you i d i o t you", "you i.d.i.o.t!", "a block-head here", "a blockxhead here", "such a SCOUNDREL", "a scou n drel"])
def test_gapped_and_inserted_letters(insulted, text):
    assert insulted.score([text.encode()])[0] >= 0.5


def test_clean_texts(insulted):
    texts = [CLEAN, "", None, "12 34", "!!!", CLEAN * 3000]
    assert (insulted.score([t and t.encode() for t in texts]) < 0.5).all()


def sample(spark, make_docs):
    good = [(i, f"Some plain sentence number {i} follows here. It ends, as it should.") for i in range(0, 60)]
    bad = [(i, f"BUY!!! NOW$$$ {i} *** $$$ !!! CHEAP***") for i in range(60, 120)]
    rows = good + bad + [(200, None), (201, ""), (None, "x"), (0, good[0][1]), (202, "word " * 60_000)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(0, 0, None), (None, 1, 1), (300, 1, 1), (5, None, None), (6, 1, 0)]
    return make_docs(rows), spark.createDataFrame(labels, LABELS), rows


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_cases(spark, make_docs, clashing, module, label):
    docs, labels, rows = sample(spark, make_docs)
    labels = labels.withColumn("text", F.lit("x")).withColumn("label", F.lit(7))
    got = module.score(clashing(docs), module.fit(clashing(docs), labels, label=label)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r.doc_id: r["score"] for r in got}
    if module is quality:
        assert by[10] > 0.9 and by[70] < 0.1
    else:
        assert by[10] < 0.5 <= by[70]
    assert len({r["score"] for r in got if r.doc_id == 0}) == 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_no_rows_one_label(spark, make_docs, module):
    docs = make_docs([(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in module.score(docs, module.fit(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert [r["score"] for r in module.score(docs, module.fit(docs, one)).collect()] == [1.0, 1.0]
    empty = make_docs([])
    assert module.score(empty, module.fit(empty, none)).collect() == []


def test_labels_of_held_out_rows_are_not_learnt(spark, make_docs):
    docs, labels, _ = sample(spark, make_docs)
    learn = lambda i: ~quality.held_out(i, 4, 2)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, quality.fit(docs, x, learn)).collect() for x in (labels, flipped))
    assert a == b
