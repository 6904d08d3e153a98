"""BPE encoding and decoding of whole texts, with tree concatenation for unsplit stretches.

The vocabulary is a file of the ``tokenizers`` library whose pre-tokenizer drops
white space; texts are encoded word by word, and a worker remembers the ids of
words that it has seen.  Words of ASCII and Latin letters are cut by the file's
own rule here; all others go through the library's normalizer and pre-tokenizer.

A stretch that the pre-tokenizer does not split (a long run of letters, or of
signs) is halved until its parts are short.  The parts are encoded on their own
and joined in a tree: around each join a window of tokens is encoded again and
grows until its first token equals the left side's and a later token falls on a
token of the right side.  Neighbouring tokens of a BPE encoding determine whether
it is one, so the joined ids are the ids of the whole.

Texts above ``LONG`` bytes are cut at white space, and inside unsplit stretches
at any place, into rows of their own; these are encoded in parallel on all
executors and joined per document.  Nulls and empty texts have no ids.  Repeated
rows stay, an empty table gives no rows, other columns are carried along or, if
they are named like a result, replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hand_over
from .batches import prepare_texts
from .text import as_bytes, whole_groups

# Characters of a stretch that are encoded at once; longer ones are halved.
PART = 2048
# Bytes of a text that one task encodes on its own.
LONG = 1 << 16
# Remembered words, and as many stretches, in two generations.
REMEMBERED = 150_000
# In digests, where a worker also does other work before and after: memory before speed.
REMEMBERED_BRIEFLY = 30_000
WORD_END = "</w>"

# Fixed by the vocabulary file: its special tokens and its splitting rule, for lower-case Latin.
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
LATIN = re.compile(r"[!-~À-ÖØ-öø-įı-ňŊ-ſ]+")
PLAIN = re.compile(rb"([a-z]+)([!-/:-@\[-`{-~]*)")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Memory(dict):
    """Answers by key, of two generations of at most ``limit``; a missing one is made."""

    def __init__(self, make: Callable[[bytes], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


# by count, the numbers of a few ids
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def as_ids(numbers: list[int]) -> bytes:
    """Numbers as little-endian unsigned 32-bit integers."""
    return PACK[len(numbers)](*numbers) if len(numbers) < 16 else np.array(numbers, "<u4").tobytes()


class Encoder:
    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.token_bytes = [t.encode() for t in self.tokens]
        self.lengths = [len(t.removesuffix(WORD_END)) for t in self.tokens]
        self.signs = byte_signs()
        self.model = self.library.model
        limit = remembered or REMEMBERED
        # one memory for both, since a stretch is looked up as the word that it is on its own
        self.words = self.stretches = Memory(self.word, 2 * limit)

    # -- stretches: what the pre-tokenizer does not split, in the signs of the vocabulary

    def stretch(self, signs: str) -> list[int]:
        if len(signs) <= PART:
            return [t.id for t in self.model.tokenize(signs)]
        half = len(signs) // 2
        return self.join(self.stretch(signs[:half]), self.stretch(signs[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two adjacent stretches as one."""
        if not left or not right:
            return left or right
        reach = 8
        while True:
            i, j = max(len(left) - reach, 0), min(reach, len(right))
            window = left[i:] + right[:j]
            again = [t.id for t in self.model.tokenize("".join(self.tokens[t].removesuffix(WORD_END) for t in window))]
            if i == 0 or again[0] == left[i]:
                if j == len(right):
                    return left[:i] + again
                starts, at = {}, sum(self.lengths[t] for t in left[i:])
                for m in range(j):
                    starts[at] = m
                    at += self.lengths[right[m]]
                at = 0
                for k, t in enumerate(again[:-1]):  # the last one ends a word that goes on
                    m = starts.get(at)
                    if k and m is not None and right[m] == t:
                        return left[:i] + again[:k] + right[m:]
                    at += self.lengths[t]
            reach *= 2

    def _stretch_bytes(self, plain: bytes) -> bytes:
        """The ids of an unsplit stretch given in UTF-8."""
        signs = plain.decode("latin-1")
        return as_ids(self.stretch(signs if plain.isascii() else signs.translate(self.signs)))

    # -- words: what stands between ASCII white space

    def stretches_of(self, word: str) -> Iterator[str | int]:
        """The unsplit stretches of a word in their order, in the signs of the vocabulary; special tokens as their id."""
        for n, part in enumerate(SPECIAL.split(word)):
            if n % 2:
                yield self.library.token_to_id(part)
            elif part:
                plain = self.library.normalizer.normalize_str(part)
                for signs, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
                    yield signs

    def word(self, word: bytes) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain:
            letters, signs = plain.groups()
            return self.words[letters] + self.words[signs] if signs else self._stretch_bytes(letters)
        text = word.decode()
        if LATIN.fullmatch(text) and "<|" not in text:
            # a stretch on its own is a word of that one stretch
            parts = [s.encode() for s in SPLIT.findall(text.lower())]
            return b"".join([self.words[s] for s in parts]) if len(parts) > 1 else self._stretch_bytes(parts[0])
        return b"".join(as_ids([s] if isinstance(s, int) else self.stretch(s)) for s in self.stretches_of(text))

    def text(self, text: bytes | None) -> bytes:
        """The ids of a text, each as a little-endian unsigned 32-bit integer."""
        if not text:
            return b""
        words = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; the file names no decoder, so tokens are joined by spaces."""
        return b" ".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, remembered)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- long texts as rows


def cut(text: bytes, enc: Encoder) -> Iterator[tuple[bytes | None, str | None, bool]]:
    """Pieces of a long text: (text, None, False), or (None, part of a stretch, whether it goes on a stretch)."""
    held: list[bytes] = []
    size = 0
    for word in (text if b"<|" in text else text.lower()).split():
        if len(word) > PART:
            if held:
                yield b" ".join(held), None, False
                held, size = [], 0
            for s in enc.stretches_of(word.decode()):
                if isinstance(s, int):
                    yield enc.tokens[s].encode(), None, False
                else:
                    for k in range(0, len(s), PART):
                        yield None, s[k : k + PART], k > 0
            continue
        held.append(word)
        size += len(word) + 1
        if size >= LONG // 2:
            yield b" ".join(held), None, False
            held, size = [], 0
    if held:
        yield b" ".join(held), None, False


def tree(parts: list[tuple[bytes, bool]], enc: Encoder) -> bytes:
    """The ids of a document from those of its pieces, and whether each goes on the stretch before it."""
    out: list[bytes] = []
    run: list[list[int]] = []

    def close() -> None:
        level = run[:]
        while len(level) > 1:
            level = [enc.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        out.extend(as_ids(ids) for ids in level)
        run.clear()

    for ids, goes_on in parts:
        if not goes_on:
            close()
        run.append(np.frombuffer(ids, "<u4").tolist())
    close()
    return b"".join(out)


def _pieces(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, REMEMBERED_BRIEFLY)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text"))):
                found = list(cut(text or b"", enc))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(found), pa.int64()),
                        pa.array(range(len(found)), pa.int32()),
                        pa.array([p[0] for p in found], pa.binary()),
                        pa.array([p[1] for p in found], pa.string()),
                        pa.array([p[2] for p in found], pa.bool_()),
                    ],
                    ["row", "nr", "piece", "stretch", "goes_on"],
                )

    return task


def _encode_pieces(path: str):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, REMEMBERED_BRIEFLY)
        for f in frames:
            ids = [
                as_ids(enc.stretch(s)) if p is None else enc.text(bytes(p))
                for p, s in zip(f["piece"], f["stretch"])
            ]
            yield f[["row", "nr", "goes_on"]].assign(ids=ids)

    return task


def _join_pieces(path: str):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, REMEMBERED_BRIEFLY)
        for f, starts in whole_groups(frames, ["row"]):
            rows = []
            for lo, hi in zip(starts[:-1], starts[1:]):
                parts = [(bytes(b), bool(g)) for b, g in zip(f["ids"][lo:hi], f["goes_on"][lo:hi])]
                rows.append((int(f["row"].iat[lo]), tree(parts, enc)))
            yield pd.DataFrame(rows, columns=["row", "ids"])

    return task


def _encode_column(path: str):
    @F.arrow_udf(T.BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([enc.text(t) for t in as_bytes(texts)], pa.binary())

    return ids.asNondeterministic()  # so that a filter behind it doesn't run it twice


def _is_long(text: str) -> Column:
    return F.coalesce(F.octet_length(text) > LONG, F.lit(False))


def encode_long(docs: DataFrame, path: str, text: str, ids: str) -> DataFrame:
    """``docs`` with ``ids``, each text cut into pieces that are encoded in parallel and joined."""
    long = hand_over(docs.withColumn("_row", F.monotonically_increasing_id()))
    pieces = hand_over(
        long.select(F.col("_row").alias("row"), F.col(text).alias("text")).mapInArrow(
            _pieces(path), "row long, nr int, piece binary, stretch string, goes_on boolean"
        )
    )
    joined = (
        pieces.repartition("row", "nr")
        .mapInPandas(_encode_pieces(path), "row long, nr int, goes_on boolean, ids binary")
        .repartition("row")
        .sortWithinPartitions("row", "nr")
        .mapInPandas(_join_pieces(path), "row long, ids binary")
    )
    # a long text without any word has no pieces
    back = long.drop(ids).join(joined.withColumnRenamed("ids", "_ids").withColumnRenamed("row", "_row"), "_row", "left")
    return back.withColumn(ids, F.coalesce("_ids", F.lit(b""))).drop("_row", "_ids")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in ``ids``, as little-endian unsigned 32-bit integers."""
    prepare_texts(docs.sparkSession)
    path = path or default_path()
    short = docs.filter(~_is_long(text)).withColumn(ids, _encode_column(path)(F.col(text)))
    return short.unionByName(encode_long(docs.filter(_is_long(text)), path, text, ids))


def _decode_column(path: str):
    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([None if i is None else enc.decode(i).decode() for i in ids.to_pylist()], pa.string())

    return text


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of each ``ids``; null ids have a null text."""
    return rows.withColumn(text, _decode_column(path or default_path())(F.col(ids)))


DIGEST = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def _digest(ids: bytes, enc: Encoder) -> dict:
    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest())
    return dict(zip(DIGEST.names, row))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encode`` and then ``decode`` give.

    Ids of a text that one task encodes don't leave that task.
    """
    path = path or default_path()
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf(DIGEST)
    def of_texts(texts: pa.Array) -> pa.Array:
        enc = encoder(path, REMEMBERED_BRIEFLY)
        return pa.array([_digest(enc.text(t), enc) for t in as_bytes(texts)], kind)

    @F.arrow_udf(DIGEST)
    def of_ids(ids: pa.Array) -> pa.Array:
        enc = encoder(path, REMEMBERED_BRIEFLY)
        return pa.array([_digest(i, enc) for i in ids.to_pylist()], kind)

    rows = docs.select("doc_id", "text")
    prepare_texts(docs.sparkSession)
    long = encode_long(rows.filter(_is_long("text")), path, "text", "ids")
    found = [
        rows.filter(~_is_long("text")).select("doc_id", of_texts("text").alias("d")),
        long.select("doc_id", of_ids("ids").alias("d")),
    ]
    return found[0].unionByName(found[1]).select("doc_id", "d.*")


def op8(spark, folder: str) -> DataFrame:
    return digests(spark.read.parquet(f"{folder}/documents.parquet"))
