"""Byte-level BPE encoding and decoding of whole texts by padded matrices.

The vocabulary is a file of ranks (one token in base 64 and its rank a line, the rank
is the id).  A text is cut by the pattern of ``public_tokenizers``; each match starts
as its bytes, and as long as two neighbours together are a token, the leftmost pair of
least rank is merged.

* Matches that a worker has not met before are encoded together, in matrices of about
  equal lengths: a row is a match, padded to the width of its bucket.  In each round
  every row merges its leftmost pair of least rank and moves what follows one place to
  the left, so that the matrix gets one column narrower; rows without a pair leave it.
  The ranks of the two pairs beside a merged one are looked up in a hash table of pairs.
* A match longer than ``PART`` bytes is cut into rows of that length.  Neighbouring rows
  are joined in a tree: a window of tokens around the joint is encoded again, and grows
  until its first token is the left side's and some later token is one of the right
  side's at the same place.  Every token of a vocabulary made by merging encodes to
  itself, and then neighbouring pairs alone decide whether tokens are an encoding.
* Windows wider than ``WIDE`` (a run of one sign whose tokens stand otherwise on both
  sides) merge all pairs of the least rank in a round, from the left.  A merged token's
  pairs have higher ranks than itself, so the order of merges is the same.
* Texts above ``LONG`` bytes are cut at the ends of matches, and inside longer matches
  anywhere, into rows that all executors encode; they are joined per document.

Null and empty texts have no ids.  Repeated rows stay, an empty table gives no rows,
other columns are carried along or, if they are named like a result, replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hand_over
from .batches import prepare_texts
from .text import whole_groups

# Bytes of a match that one row of a matrix holds.
PART = 256
# Columns beyond which a row merges all pairs of a rank at once.
WIDE = 2048
# Bytes of a text that one task encodes on its own.
LONG = 1 << 16
# Characters of texts whose matches are looked up together.
TOGETHER = 1 << 20
# Cells of a matrix.
CELLS = 1 << 21
# Longest match that is remembered, and bytes of remembered matches and ids (two generations of so many).
BRIEF, REMEMBERED = 48, 48 << 20

NONE = np.int32(2**31 - 1)

# Letters and numbers that came after Unicode 16, which the pattern's own engine does not know as such.
LATER = (
    r"\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)


def _pattern(letter: str, number: str, space: str) -> str:
    """The splitting pattern for given insides of its classes; the kinds exclude each other, so letters may come first."""
    return (
        rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


# For texts of Latin-1 characters only, the classes by their members.
LATIN = re.compile(_pattern("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xA0"))


@lru_cache(maxsize=1)
def _any_script() -> regex.Pattern:
    letter, number = rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]"
    other = rf"[^\s[\p{{L}}\p{{N}}--[{LATER}]]]"
    return regex.compile(rf"(?V1) ?{letter}+|'(?:[stmd]|re|ve|ll)| ?{number}+| ?{other}+|\s+(?!\S)|\s+")


def _pattern_of(text: str):
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _any_script()
    return LATIN


def matches(text: str) -> list[str]:
    """The parts of a text that are encoded separately."""
    return _pattern_of(text).findall(text)


class Pairs:
    """Ranks by pairs of ids: a hash table with open addressing in two arrays."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(int(2 * len(rank)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)  # 0: free
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys = self._key(left, right)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == 0
            # of those that want one place the first gets it
            _, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[at[placed]], self.ranks[at[placed]] = keys[placed], rank[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | (right.astype(np.uint64) + np.uint64(1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.MIX) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` if it is no token or one side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left.ravel()[todo], right.ravel()[todo])
        at = self._slot(keys)
        while len(todo):
            stored = self.keys[at]
            hit = stored == keys
            out.ravel()[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (stored != 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & self.mask
        return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [
            (ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        self.pairs = Pairs(*np.array(splits, np.int32).reshape(-1, 3).T)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    # -- matrices

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Each row of a matrix padded with -1, merged: its leftmost pair of least rank in every round."""
        out = np.full(ids.shape, -1, np.int32)
        which = np.arange(len(ids))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            width = ids.shape[1]
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ids)), at]
            on = best != NONE
            if not on.all():
                out[which[~on], :width] = ids[~on]
                ids, ranks, which, at, best = ids[on], ranks[on], which[on], at[on], best[on]
            row = np.arange(len(ids))
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(ids), width - 1)
            ids[row, at] = best
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(ids), width - 2)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self.pairs(best[right], ids[right, at[right] + 1])
        out[which, : ids.shape[1]] = ids
        return out

    def merge_wide(self, ids: np.ndarray) -> np.ndarray:
        """One long row merged, all pairs of the least rank in a round."""
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # where pairs overlap, as in a run of one token, every second one from the left
            new = np.diff(at, prepend=-2) != 1
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            at = at - np.arange(len(at))
            left, right = at[at > 0], at[at < len(ids) - 1]
            ranks[left - 1] = self.pairs(ids[left - 1], ids[left])
            ranks[right] = self.pairs(ids[right], ids[right + 1])
        return ids

    def merged(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte tokens, given end to end and by their sizes, merged in matrices of rows of about one length."""
        counts, found = np.zeros(len(sizes), np.int64), []
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        ranked, lo = sizes[order], int((sizes == 0).sum())
        while lo < len(order):
            shortest = int(ranked[lo])
            if shortest > WIDE:
                bucket, lo = order[lo : lo + 1], lo + 1
                ids = self.merge_wide(flat[begin[bucket[0]] : begin[bucket[0]] + shortest].copy())[None]
            else:
                # rows up to a quarter longer than the shortest share a matrix
                limit = min(max(int(shortest * 1.25), 4), WIDE)
                hi = min(int(np.searchsorted(ranked, limit, "right")), lo + max(CELLS // limit, 1))
                bucket, lo = order[lo:hi], hi
                column = np.arange(int(ranked[hi - 1]))
                inside = column < sizes[bucket][:, None]
                ids = np.full(inside.shape, -1, np.int32)
                ids[inside] = flat[(begin[bucket][:, None] + column)[inside]]
                ids = self.merge_rows(ids)
            kept = ids >= 0
            counts[bucket] = kept.sum(axis=1)
            found.append((bucket, ids[kept]))
        out, ends = np.zeros(counts.sum(), np.int32), np.cumsum(counts)
        for bucket, ids in found:
            n = counts[bucket]
            out[np.repeat(ends[bucket] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        return out, counts

    # -- joints

    def _bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[np.frombuffer(b"".join([self.tokens[i] for i in ids]), np.uint8)]

    def _agreed(self, left: np.ndarray, right: np.ndarray, reach: int, again: np.ndarray) -> np.ndarray | None:
        """The joined ids, if the encoded window agrees with both sides."""
        i, j = max(len(left) - reach, 0), min(reach, len(right))
        if i and again[0] != left[i]:
            return None
        if j == len(right):
            return np.concatenate([left[:i], again])
        ends = self.lengths[left[i:]].sum()
        starts = ends + np.cumsum(self.lengths[right[:j]]) - self.lengths[right[:j]]
        own = np.cumsum(self.lengths[again]) - self.lengths[again]
        # the window's last token may go on in the text, so it proves nothing
        _, k, m = np.intersect1d(own[:-1], starts, assume_unique=True, return_indices=True)
        same = np.flatnonzero((again[k] == right[m]) & (k > 0))
        if not len(same):
            return None
        k, m = k[same[0]], m[same[0]]
        return np.concatenate([left[:i], again[:k], right[m:]])

    def joined(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of adjacent stretches as one, for each pair of them."""
        out = [right if not len(left) else left if not len(right) else None for left, right in sides]
        todo, reach = [n for n, done in enumerate(out) if done is None], 8
        while todo:
            windows = [self._bytes_of(np.concatenate([sides[n][0][-reach:], sides[n][1][:reach]])) for n in todo]
            ids, counts = self.merged(np.concatenate(windows), np.array([len(w) for w in windows]))
            for n, again in zip(todo, np.split(ids, np.cumsum(counts)[:-1])):
                out[n] = self._agreed(*sides[n], reach, again)
            todo, reach = [n for n in todo if out[n] is None], 2 * reach
        return out

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """The ids of one stretch from those of its consecutive parts."""
        while len(parts) > 1:
            pairs = self.joined(list(zip(parts[::2], parts[1::2])))
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0] if parts else np.zeros(0, np.int32)

    # -- matches and texts

    def stretches(self, found: list[bytes]) -> list[bytes]:
        """The ids of separate stretches as little-endian unsigned 32-bit integers."""
        if not found:
            return []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rows = np.maximum(-(-sizes // PART), 1)  # parts of each stretch
        parts = np.full(rows.sum(), PART)
        last = np.cumsum(rows) - 1
        parts[last] = sizes - PART * (rows - 1)
        ids, counts = self.merged(self.bytes[np.frombuffer(b"".join(found), np.uint8)], parts)
        plain, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
        begin = (ends - counts)[last - rows + 1]
        out = [plain[4 * lo : 4 * hi] for lo, hi in zip(begin.tolist(), ends[last].tolist())]
        for n in np.flatnonzero(rows > 1):
            cuts = ends[last[n] - rows[n] + 1 : last[n]] - begin[n]
            out[n] = self.tree(np.split(ids[begin[n] : ends[last[n]]], cuts)).astype("<u4").tobytes()
        return out

    def _learn(self, found: set[str]) -> dict[str, bytes]:
        """Makes all of ``found`` known; returns the ids of those too long to be remembered."""
        if self.held > REMEMBERED:
            self.older, self.known, self.held = self.known, {}, 0
        wanted = found.difference(self.known)
        back = {m: self.older[m] for m in wanted.intersection(self.older)}
        new = list(wanted.difference(back))
        made = dict(zip(new, self.stretches([m.encode() for m in new]))) | back
        lengthy = {m: made.pop(m) for m in [m for m in made if len(m) > BRIEF]}
        self.known.update(made)
        # two objects and their place in the dictionary
        self.held += 160 * len(made) + sum(map(len, made)) + sum(map(len, made.values()))
        return lengthy

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(matches(text) if text else [])
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[bytes]:
        lengthy = self._learn(set().union(*group))
        for found in group:
            if lengthy:
                yield b"".join([self.known.get(m) or lengthy[m] for m in found])
            else:
                yield b"".join(map(self.known.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# -- long texts as rows


def cut(text: str) -> Iterator[tuple[str | None, bytes | None, bool]]:
    """Pieces of a long text: (text, None, False), or (None, part of a stretch, whether it goes on a stretch).

    A text piece ends in a match that is not white space: the pattern looks at what follows white space.
    """
    held: list[str] = []
    size = 0

    def flush() -> Iterator[tuple[str | None, bytes | None, bool]]:
        n = len(held)
        while n and held[n - 1].isspace():
            n -= 1
        if n:
            yield "".join(held[:n]), None, False
        for blank in held[n:]:
            yield None, blank.encode(), False
        held.clear()

    for found in _pattern_of(text).finditer(text):
        match = found.group()
        if len(match) > LONG // 2:
            yield from flush()
            size = 0
            plain = match.encode()
            for k in range(0, len(plain), LONG // 2):
                yield None, plain[k : k + LONG // 2], k > 0
            continue
        held.append(match)
        size += len(match)
        if size >= LONG // 2 and not match.isspace():
            yield from flush()
            size = 0
    yield from flush()


PIECE = pa.schema([("row", pa.int64()), ("nr", pa.int32()), ("piece", pa.string()), ("stretch", pa.binary()), ("goes_on", pa.bool_())])
# pieces of one text that are handed on together
PIECES = 64


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
            held = []
            for nr, piece in enumerate(cut(text.as_py() or "")):
                held.append((row, nr, *piece))
                if len(held) == PIECES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PIECE)], schema=PIECE)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PIECE)], schema=PIECE)


def _encode_pieces(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            stretches = batch.column("stretch").to_pylist()
            ids = list(known.texts(batch.column("piece").to_pylist()))
            lone = [n for n, s in enumerate(stretches) if s is not None]
            for n, found in zip(lone, known.stretches([stretches[n] for n in lone])):
                ids[n] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("nr"), batch.column("goes_on"), pa.array(ids, pa.binary())], ["row", "nr", "goes_on", "ids"]
            )

    return task


def _join_pieces(path: str):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(path)
        for f, starts in whole_groups(frames, ["row"]):
            rows = []
            for lo, hi in zip(starts[:-1], starts[1:]):
                out: list[bytes] = []
                runs: list[list[np.ndarray]] = []
                for ids, goes_on in zip(f["ids"][lo:hi], f["goes_on"][lo:hi]):
                    if not goes_on:
                        out.extend(known.tree(r).astype("<u4").tobytes() for r in runs)
                        runs = [[]]
                    runs[-1].append(np.frombuffer(bytes(ids), "<u4").astype(np.int32))
                out.extend(known.tree(r).astype("<u4").tobytes() for r in runs)
                rows.append((int(f["row"].iat[lo]), b"".join(out)))
            yield pd.DataFrame(rows, columns=["row", "ids"])

    return task


def _is_long(text: str) -> Column:
    return F.coalesce(F.octet_length(text) > LONG, F.lit(False))


def encode_long(docs: DataFrame, path: str, text: str, ids: str) -> DataFrame:
    """``docs`` with ``ids``, each text cut into pieces that are encoded in parallel and joined."""
    long = hand_over(docs.withColumn("_row", F.monotonically_increasing_id()))
    pieces = hand_over(
        long.select(F.col("_row").alias("row"), F.col(text).alias("text")).mapInArrow(
            _pieces, "row long, nr int, piece string, stretch binary, goes_on boolean"
        )
    )
    joined = (
        pieces.repartition("row", "nr")
        .mapInArrow(_encode_pieces(path), "row long, nr int, goes_on boolean, ids binary")
        .repartition("row")
        .sortWithinPartitions("row", "nr")
        .mapInPandas(_join_pieces(path), "row long, ids binary")
    )
    back = long.drop(ids).join(joined.withColumnsRenamed({"ids": "_ids", "row": "_row"}), "_row", "left")
    return back.withColumn(ids, F.coalesce("_ids", F.lit(b""))).drop("_row", "_ids")


def _encode_column(path: str):
    @F.arrow_udf(T.BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(vocabulary(path).texts(texts.to_pylist()), pa.binary())

    return ids.asNondeterministic()  # so that a filter behind it doesn't run it twice


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in ``ids``, as little-endian unsigned 32-bit integers."""
    prepare_texts(docs.sparkSession)
    path = path or default_path()
    short = docs.filter(~_is_long(text)).withColumn(ids, _encode_column(path)(F.col(text)))
    return short.unionByName(encode_long(docs.filter(_is_long(text)), path, text, ids))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that each ``ids`` stands for; null ids have none."""
    path = path or default_path()

    @F.arrow_udf(T.BinaryType())
    def bytes_of(column: pa.Array) -> pa.Array:
        known = vocabulary(path)
        return pa.array([None if i is None else known.decode(i) for i in column.to_pylist()], pa.binary())

    return rows.withColumn(decoded, bytes_of(F.col(ids)))


DIGEST = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)
DIGEST_ARROW = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(found: Iterable[bytes], known: Vocabulary) -> pa.Array:
    rows = []
    for ids in found:
        numbers = np.frombuffer(ids, "<u4").tolist()
        decimals = ",".join(map(known.decimals.__getitem__, numbers)).encode()
        plain = b"".join(map(known.tokens.__getitem__, numbers))
        row = (len(numbers), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(plain).hexdigest())
        rows.append(dict(zip(DIGEST.names, row)))
    return pa.array(rows, DIGEST_ARROW)


def _digest_udf(path: str, ids_of: Callable):
    @F.arrow_udf(DIGEST)
    def digest(column: pa.Array) -> pa.Array:
        known = vocabulary(path)
        return _digests(ids_of(known, column.to_pylist()), known)

    return digest


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encode`` and then ``decode`` give.

    Ids of a text that one task encodes don't leave that task.
    """
    path = path or default_path()
    prepare_texts(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    long = encode_long(rows.filter(_is_long("text")), path, "text", "ids")
    of_texts = _digest_udf(path, lambda known, texts: known.texts(texts))
    of_ids = _digest_udf(path, lambda known, ids: ids)
    short = rows.filter(~_is_long("text")).select("doc_id", of_texts("text").alias("d"))
    return short.unionByName(long.select("doc_id", of_ids("ids").alias("d"))).select("doc_id", "d.*")


def op13(spark, folder: str) -> DataFrame:
    return digests(spark.read.parquet(f"{folder}/documents.parquet"))
