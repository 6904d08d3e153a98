"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of terms of two kinds.  Character shapes: every byte is a lower or
upper letter, digit, space, line end, one of some signs or another sign, and each
run of three such classes is a term.  Repetition: the shares of distinct words, of
distinct word triples, of words equal to the one before and of the most frequent
word, each given as weights of the two nearest of 8 marks.  Terms are weighted by
log frequency and inverse document frequency, each kind scaled to length one, and
projected on the leading singular vectors of the training sample.

Training: labelled rows, at most ``SAMPLE`` of them, those with the least hash of
their id.  Their latent vectors and labels are broadcast (``SAMPLE * RANK`` numbers
at most, whatever the size of the input).  Every text gets the cosine to all of
them, in blocks of matrix products; the ``NEIGHBOURS`` nearest vote with their
label, weighted by a power of the cosine.  The score is the share of the votes for 1.

Whole texts count.  Null and empty texts have no terms: their vector is zero, all
votes weigh the same and the score is the share of label 1 in the sample.  Without
any labelled row the score is 0.5.  Rows with a null label or id are not learnt
from; several labels of a document are averaged.  Repeated rows stay, other
columns are carried along, those named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hand_over
from .batches import prepare_texts
from .text import as_bytes

SAMPLE = 3000
RANK = 32
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.7

SIGNS = b".,!?;:|*$%&#<>-_=/\\"
CLASSES = 16
SHAPES = CLASSES**3
MARKS = 8
REPEATS = 4
TERMS = SHAPES + REPEATS * MARKS


def _classes() -> bytes:
    """The class of each byte: letters, digits and white space first, then signs by their value."""
    table = bytearray(256)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.islower():
            table[b] = 0
        elif c.isupper():
            table[b] = 1
        elif c.isdigit():
            table[b] = 2
        elif c in "\n\r":
            table[b] = 4
        elif c.isspace():
            table[b] = 3
        elif b in SIGNS:
            table[b] = 5 + SIGNS.index(b) % 10
        else:
            table[b] = 15
    return bytes(table)


CLASS_OF = _classes()


def _marks(share: float) -> np.ndarray:
    """A share as weights of the two nearest marks."""
    out = np.zeros(MARKS, np.float32)
    at = min(max(share, 0.0), 1.0) * (MARKS - 1)
    low = min(int(at), MARKS - 2)
    out[low], out[low + 1] = low + 1 - at, at - low
    return out


def terms(text: bytes | None) -> np.ndarray:
    """Term frequencies of one text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    c = np.frombuffer(text.translate(CLASS_OF), np.uint8).astype(np.uint16)
    if len(c) >= 3:
        out[:SHAPES] = np.bincount(c[:-2] << 8 | c[1:-1] << 4 | c[2:], minlength=SHAPES)
    words = text.split()
    n = len(words)
    if n:
        counts = Counter(words)
        triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
        again = sum(map(bytes.__eq__, words, words[1:])) / n
        # long texts use words again anyway: distinct words against what the length lets expect
        distinct = len(counts) / n ** 0.9
        shares = (distinct, triples, again, counts.most_common(1)[0][1] / n)
        out[SHAPES:] = np.concatenate([_marks(s) for s in shares])
    return out


def _scaled(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


@dataclass
class Model:
    """A fitted classifier; its size does not depend on the corpus."""

    weights: np.ndarray  # inverse document frequency of each shape
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled latent vectors of length one
    labels: np.ndarray

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        shapes = _scaled(np.log1p(counts[:, :SHAPES]) * self.weights)
        return np.hstack([shapes, _scaled(counts[:, SHAPES:])])

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _scaled(self.weighted(counts) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = np.clip(self.latent(counts) @ self.vectors.T, 0, 1)
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.take_along_axis(cosine, near, axis=1).astype(np.float64) ** POWER
        total = votes.sum(1)
        share = (votes * self.labels[near]).sum(1)
        return np.where(total > 0, share / np.where(total > 0, total, 1), self.labels.mean())


def fit_model(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Latent axes and labelled vectors of a sample, a row of term counts for each text."""
    n = len(labels)
    weights = np.log((1 + n) / (1 + (counts[:, :SHAPES] > 0).sum(0))).astype(np.float32) + 1
    model = Model(weights, np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), labels)
    if n:
        matrix = model.weighted(counts)
        # singular vectors by a few rounds on a random subspace
        start = np.random.default_rng(7).standard_normal((TERMS, min(RANK + 16, TERMS))).astype(np.float32)
        for _ in range(4):
            start, _ = np.linalg.qr(matrix.T @ (matrix @ start))
        _, _, turn = np.linalg.svd(matrix @ start, full_matrices=False)
        axes = start @ turn.T
        model.axes[:, : min(RANK, axes.shape[1])] = axes[:, :RANK]
        model.vectors = model.latent(counts)
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int) -> DataFrame:
    """``text, label``: at most ``rows`` labelled rows for which ``learn(doc_id)`` holds, by the hash of their id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.avg(label).alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")  # ``rows`` rows


def fit(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: F.lit(True), label: str = "quality") -> Model:
    """Learn from at most ``SAMPLE`` labelled documents; repeated documents add at most as many again."""
    prepare_texts(docs.sparkSession)
    sample = hand_over(labelled(docs, labels, label, learn, SAMPLE))
    rows = sample.orderBy(F.xxhash64("text"), "label").limit(SAMPLE).withColumn("terms", _terms("text"))
    found = rows.select("terms", "label").toPandas()
    counts = np.stack([np.frombuffer(t, np.float32) for t in found["terms"]]) if len(found) else np.zeros((0, TERMS), np.float32)
    return fit_model(counts, found["label"].to_numpy(np.float64))


@F.arrow_udf(T.BinaryType())
def _terms(texts: pa.Array) -> pa.Array:
    return pa.array([terms(t).tobytes() for t in as_bytes(texts)], pa.binary())


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1."""
    prepare_texts(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        rows = as_bytes(texts)
        blocks = [np.stack([terms(t) for t in rows[k : k + 256]]) for k in range(0, len(rows), 256)]
        return pa.array(np.concatenate([sent.value.score(b) for b in blocks] or [np.zeros(0)]))

    return docs.withColumn(into, scored.asNondeterministic()(F.col(text)))


def held_out(doc_id, parts: int, part: int):
    """Whether a document's part, by the checksum of its id as text, is the one kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def good_ones(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score below ``THRESHOLD``."""
    scored = score(docs, fit(docs, labels, lambda i: ~held_out(i, 4, 2)), into="_score")
    return scored.filter(F.col("_score") >= THRESHOLD).select(*docs.columns)


def op1(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit(docs, labels, lambda i: ~held_out(i, 4, 2))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
