"""The registered queries: against their SQL where there is one, and the pipeline stage by stage."""

from __future__ import annotations

import corpus_pipeline
import pytest
from oracle import connect, difference, duck_result, spark_result

import __spark_entry__ as entry
from gapweave.llm import catalog
from gapweave.session import hand_over


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_against_sql(spark, folder, name):
    got = spark_result(entry.queries()[name](spark, folder))
    assert got[1] and difference(got, duck_result(connect(folder), entry.oracle_sql()[name])) is None


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_pipeline(spark, folder):
    from test_passages import repeats
    from test_postings import brute as leaks
    from test_simhash import brute as components

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        docs = hand_over(stage(spark, docs, folder))
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "bpe encoding":
            assert docs.columns == columns
        if name == "quality classifier":
            good = catalog.QUERIES["op1_neighbour_quality"](spark, folder).filter("predicted = 1")
            assert kept[name] == {r.doc_id for r in good.collect()}
        if name == "near dedup":
            assert kept[name] == {eval(r)[2] for r in components(list(before.items()))}
        if name == "substring dedup":
            after = [(r.doc_id, r.text) for r in docs.collect()]
            assert not repeats(after) and {d for d in before if d not in repeats(list(before.items()))} <= kept[name]
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert kept[name] == {eval(r)[0] for r in leaks(list(before.items()), items) if not eval(r)[2]}
    assert kept["bpe encoding"] == kept["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept["bpe encoding"]
