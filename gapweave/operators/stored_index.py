"""A search index that is written once and searched any number of times.

Three tables, all in buckets so that a search shuffles only its own side:

* ``words``: each word of a channel with how many documents have it and its greatest count;
* ``blocks``: the postings of a word in the order of their impact (its count, falling), cut into
  blocks of at most ``BLOCK`` documents, each with its greatest count;
* ``vectors``: the words of each document with their counts.

A search first adds up, for each document in the leading blocks of a query's words, what those
blocks say about it.  The k-th of these sums is a bound that the answer reaches.  A document whose
every count is below its word's greatest count times (bound / the most the words can give) stays
below the bound, so only blocks whose greatest count is at least that are opened; the documents
in them are scored from their vectors.  No text is read and no posting of a closed block.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hand_over
from . import hits
from .search import PAIR, PLACES, QUERY, SLACK, WORD_BREAK, words

# Documents of a block.
BLOCK = 128
# Bytes of text whose postings are one range, which a task sorts and cuts into blocks.
RANGE_BYTES = 32 << 20
# Queries whose weights a task remembers.
REMEMBERED = 1000
TABLES = ("words", "blocks", "vectors")


@dataclass
class Index:
    """The tables of a written index and the number of its documents."""

    words: DataFrame
    blocks: DataFrame
    vectors: DataFrame
    n_docs: int


def _vectors(corpus: DataFrame) -> DataFrame:
    """``channel, doc_id, tf``: the words of each document with their counts, counted where the document's text is."""
    cut = corpus.select("channel", "doc_id", F.explode(F.split(F.lower("text"), WORD_BREAK)).alias("word")).filter("word != ''")
    counted = cut.groupBy("channel", "doc_id", "word").agg(F.count("*").cast("int").alias("n"))
    vector = F.map_from_entries(F.collect_list(F.struct("word", "n")))  # one document
    return counted.groupBy("channel", "doc_id").agg(vector.alias("tf"))


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    left, right = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.or_(pc.fill_null(pc.not_equal(left, right), False), pc.xor(left.is_null(), right.is_null()))
    return differ.to_numpy(zero_copy_only=False)


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that come in the order of their impact, word by word (but for equal hashes)."""
    held: pa.RecordBatch | None = None  # from the first posting of a block on

    def blocks(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        first, offsets = pa.array(starts[:-1]), pa.array(starts, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c).slice(0, starts[-1])) for c in ("doc_id", "tf")]
        sizes = pa.array(np.diff(starts), pa.int32())
        columns = [*(batch.column(c).take(first) for c in ("channel", "word", "tf")), sizes, *lists]
        return pa.RecordBatch.from_arrays(columns, ["channel", "word", "max_tf", "n", "docs", "tfs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.RecordBatch.from_arrays(
                [pa.concat_arrays([held.column(c), batch.column(c)]) for c in batch.schema.names], schema=batch.schema
            )
        new = np.append(True, _changes(batch.column("channel")) | _changes(batch.column("word")))
        at = np.arange(len(new))
        since = at - np.maximum.accumulate(np.where(new, at, 0))
        starts = np.flatnonzero(since % BLOCK == 0)
        if len(starts) > 1:
            yield blocks(batch, starts)
        held = batch.slice(starts[-1])
    if held is not None:
        yield blocks(held, np.array([0, held.num_rows]))


def build(corpus: DataFrame, n_docs: int, path: str, name: str | None = None, buckets: int | None = None) -> Index:
    """Write the index of ``corpus(channel, doc_id, text)`` below ``path`` and return it."""
    spark = corpus.sparkSession
    name = name or f"index_{uuid.uuid4().hex}"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets or max(least, -(-size // RANGE_BYTES))

    def save(table: str, written: DataFrame, keys: list[str]) -> DataFrame:
        """Written as it is dealt out, by its buckets, so that every bucket is one file."""
        write = written.write.bucketBy(n, *keys).sortBy(*keys).mode("overwrite")
        write.option("path", f"{path.rstrip('/')}/{table}").saveAsTable(f"{name}_{table}")
        return spark.table(f"{name}_{table}")

    of_word = ["word", "channel"]
    vectors = save("vectors", _vectors(corpus.repartition(n, "doc_id")), ["doc_id"])
    found = vectors.select("channel", "doc_id", F.explode("tf").alias("word", "tf"))
    save("words", found.groupBy(*of_word).agg(F.count("*").alias("df"), F.max("tf").alias("max_tf")).repartition(n, *of_word), of_word)
    # words by their hash and falling counts as one number, which sorts faster than texts; the
    # others decide where it is the same.  A word with any number of postings covers several
    # ranges; a block is a part of one
    impact = F.shiftleft(F.hash(*of_word).cast("long"), 32) + (F.lit((1 << 31) - 1) - F.col("tf"))
    by = ["_impact", *of_word, "doc_id"]
    ranged = found.withColumn("_impact", impact).repartitionByRange(n, *by).sortWithinPartitions(*by)
    cut = T.StructType().add("channel", "string").add("word", "string").add("max_tf", "integer").add("n", "integer")
    cut = cut.add("docs", T.ArrayType(found.schema["doc_id"].dataType)).add("tfs", T.ArrayType(T.IntegerType()))
    save("blocks", ranged.select("channel", "word", "doc_id", "tf").mapInArrow(_cut_blocks, cut).repartition(n, *of_word), of_word)
    meta = spark.createDataFrame([(json.dumps({"name": name, "n_docs": n_docs}),)], "value string")
    meta.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/meta")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    """The index written below ``path``; its tables are looked up in the catalog, where their buckets are known."""
    meta = json.loads(spark.read.text(f"{path.rstrip('/')}/meta").first().value)
    return Index(*[spark.table(f"{meta['name']}_{t}") for t in TABLES], meta["n_docs"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The score of each pair; the pairs of a document come one after another, so its counts are unpacked once."""
    counts, last, weights = {}, None, {}
    for batch in batches:
        pairs = [batch.column(c) for c in PAIR]
        words, idfs, tf = (batch.column(c) for c in ("words", "idfs", "tf"))
        starts, keys, values = tf.offsets.to_numpy(), tf.keys, tf.items  # of all rows, without a copy
        out = []
        for row, (entity, channel, doc) in enumerate(zip(*(c.to_pylist() for c in pairs))):
            if (channel, doc) != last:
                lo, hi = starts[row], starts[row + 1]
                last, counts = (channel, doc), dict(zip(keys[lo:hi].to_pylist(), values[lo:hi].to_pylist()))
            if (entity, channel) not in weights:
                if len(weights) >= REMEMBERED:
                    weights.clear()
                weights[entity, channel] = list(zip(words[row].as_py(), idfs[row].as_py()))
            score, get = 0.0, counts.get
            for word, idf in weights[entity, channel]:
                tf_of = get(word)
                if tf_of is not None:
                    score += tf_of * idf
            out.append(score)
        yield pa.RecordBatch.from_arrays([*pairs, pa.array(out, pa.float64())], [*PAIR, "score"])


def search(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The ``k`` best documents of each channel for every query, as an exhaustive search would give them."""
    asked = queries.select("entity_id", F.explode(F.array_distinct(words(F.col("name")))).alias("word"))
    idf = F.log((F.lit(index.n_docs) + 1) / (F.col("df") + 1))
    known = index.words.withColumn("idf", idf)
    # words that all documents have, or nearly, add nothing or less
    terms = hand_over(asked.join(known, "word").select(*QUERY, "word", "max_tf", "idf"))
    first = index.blocks.join(index.words.select("channel", "word", F.col("max_tf").alias("_most")), ["channel", "word"])
    leading = first.filter(F.col("max_tf") == F.col("_most")).select("channel", "word", F.arrays_zip("docs", "tfs").alias("p"))
    seen = leading.join(terms.filter("idf > 0").select(*QUERY, "word", "idf"), ["channel", "word"]).select(*QUERY, "idf", F.inline("p"))
    sums = seen.groupBy(*QUERY, F.col("docs").alias("doc_id")).agg(F.sum(F.col("tfs") * F.col("idf")).alias("score"))
    reached = hits.top_k(sums, QUERY, [F.desc("score"), "doc_id"], k, "_r").groupBy(*QUERY).agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    most = terms.groupBy(*QUERY).agg(F.sum(F.greatest(F.col("idf") * F.col("max_tf"), F.lit(0.0))).alias("most"), F.min("idf").alias("_least"))
    # a negative weight could lower a sum below the bound, so such queries open all blocks
    share = F.when(F.col("_least") >= 0, F.greatest(F.try_divide(F.col("bound") - SLACK, F.col("most")), F.lit(0.0)))
    limits = terms.join(most, QUERY).join(reached, QUERY, "left").select(*QUERY, "word", (F.coalesce(share, F.lit(0.0)) * F.col("max_tf")).alias("least_tf"))
    opened = index.blocks.join(limits, ["channel", "word"]).filter("max_tf >= least_tf")
    postings = opened.select(*QUERY, "least_tf", F.inline(F.arrays_zip("docs", "tfs")))
    pairs = postings.filter("tfs >= least_tf").select(*QUERY, F.col("docs").alias("doc_id")).distinct()
    # the words of one query
    listed = terms.groupBy(*QUERY).agg(F.sort_array(F.collect_list(F.struct("word", "idf"))).alias("terms"))
    listed = listed.select(*QUERY, F.col("terms.word").alias("words"), F.col("terms.idf").alias("idfs"))
    p, v = pairs.join(listed, QUERY).alias("p"), index.vectors.alias("v")
    # met by document alone, as the buckets are; an equality of channels would have the vectors dealt out anew
    same = F.expr("p.doc_id = v.doc_id AND p.channel >= v.channel AND p.channel <= v.channel")
    met = p.join(v, same).select("p.*", "v.tf").sortWithinPartitions("doc_id")
    kinds = T.StructType([met.schema[c] for c in PAIR]).add("score", "double")
    scored = met.select(*PAIR, "words", "idfs", "tf").mapInArrow(_scores, kinds).withColumn("score", F.round("score", PLACES))
    return hits.top_k(scored, QUERY, [F.desc("score"), "doc_id"], k, "channel_rank")
