"""The registered queries of this subpackage."""

from __future__ import annotations

from . import bpe, byte_bpe, interaction, merkle, passages, postings, quality, quotes, sequences, shards, simhash, topk, toxicity

QUERIES = {
    "op1_neighbour_quality": quality.op1,
    "op2_simhash_components": simhash.op2,
    "op3_threshold_topk": topk.op3,
    "op4_subsequence_toxicity": toxicity.op4,
    "op5_balanced_shards": shards.op5,
    "op6_quotation_threads": quotes.op6,
    "op7_arrow_sequences": sequences.op7,
    "op8_bpe_round_trip": bpe.op8,
    "op9_repeated_passages": passages.op9,
    "op10_benchmark_leaks": postings.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_filter_interactions": interaction.op12,
    "op13_byte_bpe_round_trip": byte_bpe.op13,
}
ORACLES = {
    "op3_threshold_topk": topk.OP3_SQL,
    "op10_benchmark_leaks": postings.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_filter_interactions": interaction.OP12_SQL,
}


def _pipeline(spark, folder: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict:
    return QUERIES | {"pipeline": _pipeline}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
