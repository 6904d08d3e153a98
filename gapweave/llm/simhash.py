"""Near-duplicate documents by SimHash, with candidates from pigeonring chains.

Fingerprint: A-Z is lower-cased, words are runs of non-white-space (ASCII white
space), shingles three words joined by a space, repeats included (fewer words:
the whole sequence; none, or a null text: fingerprint zero).  A bit is set if it
is set in more than half of the shingles' XXH64 values (seed 42).

Candidates: the 64 bits are a ring of 8 segments.  If two fingerprints differ in
at most 3 bits, the pigeonring principle gives a segment from which every chain
of l consecutive segments holds at most 3 * l / 8 differences: none in the first
two, at most one in the first five.  So of segments 3 to 5 of that chain two are
equal, and 32 known bits of both are equal: each fingerprint is filed under
8 starts x 3 choices of such bits.  Pairs that meet there must keep the budget of
every longer chain before the full Hamming distance is taken.

Only distinct fingerprints are compared; documents that share one are linked by
it.  The pairs of one key are not written out, see ``links``.
Documents with a null id take part; a component of null ids only has a null id.
Repeated rows stay.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hand_over
from .batches import prepare_texts
from .components import smallest_reachable
from .text import as_bytes, whole_groups

SEED = 42
WORDS = 3
BITS = 3
SEGMENTS = 8
# members of one key that are compared with each other in one task
BLOCK = 2048


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - WORDS + 1, 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        block = hashes[k : k + 4096]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in as_bytes(texts)], np.uint64).view(np.int64))


def _segment(bits: Column, i: int) -> Column:
    return F.shiftrightunsigned(bits, 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))


def chain_keys(bits: Column) -> Column:
    """The 24 keys of a fingerprint: start, choice, and the four segments that must be equal."""
    keys = []
    for start in range(SEGMENTS):
        for choice, pair in enumerate([(2, 3), (2, 4), (3, 4)]):
            key = F.lit(start * 3 + choice)
            for i in (0, 1, *pair):
                key = F.shiftleft(key.cast("long"), 8).bitwiseOR(_segment(bits, start + i))
            keys.append(key)
    return F.array(*keys)


def close_pairs(x: np.ndarray, y: np.ndarray, turn: int) -> tuple[list, list]:
    """Pairs of one key that keep the budget of every chain from bit ``turn`` of the ring, and of the whole ring."""
    found: tuple[list, list] = ([], [])
    x, y = x.view(np.uint64), y.view(np.uint64)
    for k in range(0, len(x), 256):
        apart = x[k : k + 256, None] ^ y[None, :]
        ring = (apart >> np.uint64(turn)) | (apart << np.uint64(64 - turn)) if turn else apart
        kept = np.ones(ring.shape, bool)
        for length in range(3, SEGMENTS + 1):
            chain = ring & np.uint64((1 << 8 * length) - 1)
            kept &= np.bitwise_count(chain) <= BITS * length // SEGMENTS
        a, b = np.nonzero(kept)
        found[0].extend(x[k + a].view(np.int64).tolist())
        found[1].extend(y[b].view(np.int64).tolist())
    return found


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of each group, as one link from every member to the least that it reaches."""
    for frame, starts in whole_groups(frames, ["key", "i", "j"]):
        bits, blocks = frame["bits"].to_numpy(), frame["block"].to_numpy()
        turn = frame["key"].to_numpy() // (3 << 32) * 8
        for lo, hi in zip(starts[:-1], starts[1:]):
            members = np.sort(bits[lo:hi])
            if hi - lo > 1:
                if frame["i"].iat[lo] != frame["j"].iat[lo]:  # pairs inside one block are met elsewhere
                    first = blocks[lo:hi] == frame["i"].iat[lo]
                    x, y = bits[lo:hi][first], bits[lo:hi][~first]
                else:
                    x = y = members
                least = {m: m for m in members.tolist()}

                def find(m: int) -> int:
                    while least[m] != m:
                        least[m] = m = least[least[m]]
                    return m

                for a, b in zip(*close_pairs(x, y, int(turn[lo]))):
                    a, b = find(a), find(b)
                    least[max(a, b)] = min(a, b)
                linked = [(find(m), m) for m in least if find(m) != m]
                if linked:
                    yield pd.DataFrame(linked, columns=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """``a, b`` with a < b: enough links between the distinct fingerprints of ``prints(bits)``.

    Two fingerprints are connected by them if and only if they are by the pairs
    that differ in at most three bits.  Members of one key are compared inside
    their task and leave it as one link each.  A key of many members is dealt out
    as pairs of blocks, so that no task holds more than two blocks of it.
    """
    filed = prints.select(F.explode(chain_keys(F.col("bits"))).alias("key"), "bits")
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    met = (
        filed.join(shared, "key")
        .withColumn("block", F.pmod(F.xxhash64("bits"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        .select("key", "bits", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    groups = ["key", "i", "j"]
    return met.repartition(*groups).sortWithinPartitions(*groups).mapInPandas(_forest, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tid, bits, component_id, root``, a row for each document.

    ``tid`` is a hash of the text, ``root`` the least fingerprint of the component.
    """
    prepare_texts(docs.sparkSession)
    printed = hand_over(
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tid"), simhash(text).alias("bits"))
    )
    prints = hand_over(printed.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = smallest_reachable(links(prints))
    rooted = prints.join(roots, prints["bits"] == roots["node"], "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(components, "root").select("bits", "component_id", "root")
    return printed.join(named, "bits").select("doc_id", "tid", "bits", "component_id", "root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of least id (nulls last), then of least text hash."""
    rows = hand_over(near_duplicates(docs, doc_id, text))
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tid")).alias("c")
    kept = hand_over(rows.groupBy("root").agg(least).select(F.col("c.doc_id").alias("_doc"), F.col("c.tid").alias("_tid")))
    known = docs.withColumn("_own", F.xxhash64(text))
    met = known[doc_id].eqNullSafe(kept["_doc"]) & (known["_own"] == kept["_tid"])
    left = known.join(kept, met, "left_semi")
    repeated = rows.groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.limit(1).count():  # rows equal in id and text
        left = left.dropDuplicates([doc_id, "_own"])
    return left.select(*docs.columns)


def op2(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
