"""Toxicity scores by a support vector machine on a subsequence string kernel.

Kernel: two stretches of text are alike if they share subsequences of ``LENGTH``
letters; an occurrence that spans more letters than that counts ``DECAY`` per
letter in between, and at most ``SPAN`` letters are spanned.  So "idiot", "id-iot",
"i d i o t" and "idxiot" share most of their subsequences.  A-Z is lower-cased,
other letters fall into a few classes, and everything between letters counts as
one separator, which may itself be part of a subsequence; separators inside a word
spelt out letter by letter are dropped.

Landmarks are the pieces of the labelled sentences that tell the labels apart best,
and frequent pieces of sentences labelled 0.  The kernel values of a stretch with
the landmarks, turned by the inverse root of the landmarks' own kernel matrix
(Nystroem), are the features of a linear machine with squared hinge loss.  A label
belongs to a whole document, so the machine learns from the stretch of each
document labelled 1 that it finds most toxic, and from several such stretches of
each document labelled 0, in a few rounds.  Each toxic stretch is learnt a second
time with a letter or separator put in, so that disturbed spellings pass too.  Its decision is a weighted sum of
kernel values with the landmarks, thus a sum of one weight for each subsequence;
those weights are what every stretch of every document is scored with.

A document's score is that of its most toxic stretch, set so that 0.5 parts the
training documents best (a false alarm counts ``FALSE_ALARM`` times a miss).  Whole texts count.  Null and empty texts score like a text
without letters.  Training uses at most ``TOXIC`` documents labelled 1 and ``CLEAN``
labelled 0, of at most ``TRAIN_BYTES`` bytes each, those with the least hash of their
id.  If one of the labels is missing there, the score is the share of label 1, or
0.5 without any.  Contradicting labels of a document are averaged and count as 1
from 0.5 on.  Repeated rows stay, other columns are carried along, those named like
a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hand_over
from .batches import prepare_texts
from .quality import held_out, labelled
from .text import as_bytes

LENGTH = 4
SPAN = 7
DECAY = 0.7
STRETCH = 8
PIECE = 6
TOXIC, CLEAN = 1000, 1500
TRAIN_BYTES = 20_000
LANDMARKS, PLAIN_LANDMARKS = 260, 60
ROUNDS = 5
# what a share of documents wrongly called toxic counts against the same share of toxic ones missed
FALSE_ALARM = 3.0
# copies of each toxic stretch with an inserted letter or separator, to learn from
DISTURBED = 1
THRESHOLD = 0.5
BITS = 5
# letters scored at once, so that the arrays stay in the processor's cache
BLOCK = 1 << 16


def _letters() -> np.ndarray:
    """The class of each character: 0 between letters, 1-26 for a-z, 27-31 for other letters."""
    table = np.zeros(0x10000, np.int64)
    for c in range(0x10000):
        if chr(c).isalpha():
            small = ord(chr(c).lower()[0])
            table[c] = small - 96 if c < 128 else 27 + small % 5
    return table


LETTERS = _letters()


def codes(text: bytes | None) -> np.ndarray:
    """A text as letter classes, with one separator before, between and behind words."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = LETTERS[np.minimum(points, 0xFFFF)]
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    # three or more single letters in a row are one spelt-out word: drop the separators between them
    single = np.zeros(len(c) + 8, bool)
    single[1 : len(c) - 1] = (c[1:-1] != 0) & (c[:-2] == 0) & (c[2:] == 0)
    left, right = single[np.maximum(np.arange(len(c)) - 1, 0)], single[np.arange(len(c)) + 1]
    run = (c == 0) & left & right
    further = (single[np.maximum(np.arange(len(c)) - 3, 0)] & (np.arange(len(c)) >= 3)) | single[np.arange(len(c)) + 3]
    return c[~(run & further)]


PATTERNS = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]


def subsequences(c: np.ndarray, n: int) -> Iterator[tuple[float, np.ndarray]]:
    """For each gap pattern its weight, and the number of the subsequence at each of the first n places."""
    pairs = {g: (c[: len(c) - g] << BITS) | c[g:] for g in range(1, SPAN)}
    for _, i, j, k in PATTERNS:
        yield DECAY ** (k + 1 - LENGTH), (pairs[i][:n] << 2 * BITS) | pairs[k - j][j : j + n]


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another, apart by enough separators, and where each begins."""
    gap = np.zeros(SPAN + STRETCH, np.int64)
    joined = np.concatenate([x for p in parts for x in (p, gap)] or [gap])
    starts = np.cumsum([0] + [len(p) + len(gap) for p in parts])[:-1]
    return joined, starts


def stretch_scores(c: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of subsequence weights of the stretch that begins at each place."""
    n = len(c) - SPAN + 1
    at = np.zeros(len(c), np.float32)
    for lo in range(0, n, BLOCK):
        m = min(BLOCK, n - lo)
        by_weight: dict[float, np.ndarray] = {}
        for w, idx in subsequences(c[lo : lo + m + SPAN - 1], m):
            found = weights.take(idx)
            if w in by_weight:
                by_weight[w] += found
            else:
                by_weight[w] = found
        for w, found in by_weight.items():
            at[lo : lo + m] += np.float32(w) * found
    total = np.concatenate([[0.0], np.cumsum(at, dtype=np.float64)])
    ends = np.minimum(np.arange(len(c)) + STRETCH, len(c))
    return total[ends] - total[:-1]


@dataclass
class Model:
    """A fitted machine: one weight per subsequence, and how a margin becomes a score."""

    weights: np.ndarray
    middle: float
    slope: float
    constant: float | None = None

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        c, starts = padded([codes(t) for t in texts])
        return np.maximum.reduceat(stretch_scores(c, self.weights), starts) if len(texts) else np.zeros(0)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip((self.margins(texts) - self.middle) * self.slope, -50, 50)))


def _pieces(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pieces of each document, counted over all documents."""
    found = []
    for c in docs:
        n = len(c) - PIECE + 1
        if n > 0:
            number = sum(c[i : i + n] << BITS * (PIECE - 1 - i) for i in range(PIECE))
            found.append(np.unique(number[(c[1 : n + 1] != 0)]))
    return np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)


def landmarks(toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
    """Pieces as rows of letter classes: those that tell the labels apart, then plain ones."""
    (t, tn), (c, cn) = _pieces(toxic), _pieces(clean)
    in_clean = np.zeros(len(t))
    place = np.minimum(np.searchsorted(c, t), max(len(c) - 1, 0))
    if len(c):
        in_clean = np.where(c[place] == t, cn[place], 0)
    odds = np.log((tn + 0.5) / (len(toxic) + 1)) - np.log((in_clean + 0.5) / (len(clean) + 1))
    telling = np.where(tn >= 2, tn * odds, 0)
    best = np.argsort(-telling, kind="stable")[:LANDMARKS]
    best = best[telling[best] > 0]
    plain = c[np.argsort(-cn, kind="stable")[:PLAIN_LANDMARKS]]
    numbers = np.unique(np.concatenate([t[best], plain]))
    return np.stack([(numbers >> BITS * (PIECE - 1 - i)) & 31 for i in range(PIECE)], axis=1)


def _machine(x: np.ndarray, y: np.ndarray, ridge: float = 30.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, the last one a bias; Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        inside = y * (x @ w) < 1
        weighted = x[inside] * share[inside, None]
        new = np.linalg.solve(keep + weighted.T @ x[inside], weighted.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def fit_model(texts: list[bytes | None], labels: np.ndarray) -> Model:
    """Fit on whole documents with one label each."""
    y = np.where(np.asarray(labels) >= 0.5, 1.0, -1.0)
    size = 1 << LENGTH * BITS
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(1, np.float32), 0.0, 1.0, float((y > 0).mean()) if len(y) else 0.5)
    docs = [codes(t) for t in texts]
    marks = landmarks([d for d, v in zip(docs, y) if v > 0], [d for d, v in zip(docs, y) if v < 0])
    # the landmarks' subsequences, each landmark scaled to length one
    sums: list[dict[int, float]] = []
    for mark in marks:
        own: dict[int, float] = {}
        for places in combinations(range(PIECE), LENGTH):
            number = 0
            for p in places:
                number = number << BITS | int(mark[p])
            own[number] = own.get(number, 0.0) + DECAY ** (places[-1] - places[0] + 1 - LENGTH)
        sums.append(own)
    numbers = np.unique([u for own in sums for u in own])
    inside = np.zeros((len(numbers), len(marks)))
    for m, own in enumerate(sums):
        inside[np.searchsorted(numbers, list(own)), m] = list(own.values())
    inside /= np.linalg.norm(inside, axis=0)
    values, vectors = np.linalg.eigh(inside.T @ inside)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # Nystroem: features are kernel values times this
    row_of = np.full(size, -1, np.int32)
    row_of[numbers] = np.arange(len(numbers))
    c, starts = padded(docs)
    spans = list(zip(starts, [*starts[1:], len(c)]))

    def stretches(places: np.ndarray) -> np.ndarray:
        return c[np.minimum(places[:, None] + np.arange(STRETCH + SPAN - 1), len(c) - 1)]

    def features(found: np.ndarray) -> np.ndarray:
        out = np.zeros((len(found), len(marks)))
        for step in range(STRETCH):
            window = found[:, step : step + SPAN]
            for _, i, j, k in PATTERNS:
                number = ((window[:, 0] << BITS | window[:, i]) << BITS | window[:, j]) << BITS | window[:, k]
                rows = row_of[number]
                hit = rows >= 0
                out[hit] += DECAY ** (k + 1 - LENGTH) * inside[rows[hit]]
        return out @ root

    rng = np.random.default_rng(5)
    spread = np.zeros(size, np.float32)
    # first guess: landmarks that only occur in documents labelled 1
    first = np.array([1.0 if t else 0.0 for t in _telling(marks, docs, y)])
    spread[numbers] = inside @ first
    negatives: list[np.ndarray] = []
    for _ in range(ROUNDS):
        scores = stretch_scores(c, spread)
        tops = np.maximum.reduceat(scores, starts)
        level = np.quantile(tops[y < 0], 0.95)
        positives = []
        for (lo, hi), label, top in zip(spans, y, tops):
            own = scores[lo:hi].copy()
            for n in range(4):
                best = int(own.argmax())
                if label > 0 and n and own[best] < max(level, top / 3):
                    break  # one stretch in any case, others only if they stand out
                (positives if label > 0 else negatives).append(lo + best)
                own[max(best - STRETCH, 0) : best + STRETCH] = -np.inf
        worst = np.unique(negatives)
        toxic = stretches(np.array(positives))
        toxic = np.concatenate([toxic, *(_disturbed(toxic, rng) for _ in range(DISTURBED))])
        w = _machine(features(np.concatenate([toxic, stretches(worst)])), np.concatenate([np.ones(len(toxic)), -np.ones(len(worst))]))
        spread[numbers] = inside @ (root @ w[:-1])
    top = np.maximum.reduceat(stretch_scores(c, spread), starts)
    order = np.sort(top)
    cuts = (order[1:] + order[:-1]) / 2
    right = np.array([np.mean(top[y > 0] >= t) - FALSE_ALARM * np.mean(top[y < 0] >= t) for t in cuts])
    best = int(np.argmax(right))
    middle = float(cuts[best])
    apart = np.median(top[y > 0]) - np.median(top[y < 0])
    return Model(spread, middle, 6.0 / max(float(apart), 1e-6))


def _disturbed(found: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Copies of stretches with a separator or a letter put in at some place inside."""
    out = found.copy()
    at = rng.integers(2, STRETCH, len(found))
    sign = np.where(rng.random(len(found)) < 0.5, 0, rng.integers(1, 27, len(found)))
    for row, k, s in zip(out, at, sign):
        row[k + 1 :] = row[k:-1].copy()
        row[k] = s
    return out


def _telling(marks: np.ndarray, docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which landmarks are at least five times as frequent in documents labelled 1."""
    numbers = sum(marks[:, i] << BITS * (PIECE - 1 - i) for i in range(PIECE))
    rates = []
    for sign in (1, -1):
        found, n = _pieces([d for d, v in zip(docs, y) if v == sign])
        place = np.minimum(np.searchsorted(found, numbers), max(len(found) - 1, 0))
        there = np.where(found[place] == numbers, n[place], 0) if len(found) else np.zeros(len(numbers))
        rates.append(there / max((y == sign).sum(), 1))
    return rates[0] > 5 * rates[1]


def fit(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: F.lit(True), label: str = "toxic") -> Model:
    """Learn from bounded samples of both labels."""
    fitting = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_BYTES)
    known = labels.join(fitting.select("doc_id").distinct(), "doc_id", "left_semi")
    means = known.groupBy("doc_id").agg(F.avg(label).alias(label))
    samples = [
        labelled(fitting, means.filter(side), label, learn, n).limit(2 * n)
        for side, n in ((F.col(label) >= 0.5, TOXIC), (F.col(label) < 0.5, CLEAN))
    ]
    found = hand_over(samples[0].union(samples[1])).toPandas()
    found = found.sort_values(["label", "text"], kind="stable")
    return fit_model([t.encode() for t in found["text"]], found["label"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1."""
    prepare_texts(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        rows = as_bytes(texts)
        found = [sent.value.score(rows[k : k + 128]) for k in range(0, len(rows), 128)]
        return pa.array(np.concatenate(found or [np.zeros(0)]))

    return docs.withColumn(into, scored.asNondeterministic()(F.col(text)))


def op4(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit(docs, labels, lambda i: ~held_out(i, 5, 0))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
