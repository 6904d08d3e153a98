"""Byte-level BPE against the tiktoken library, whole texts and pieces."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gapweave.llm import byte_bpe


@pytest.fixture(scope="module")
def known():
    return byte_bpe.vocabulary(byte_bpe.default_path())


@pytest.fixture(scope="module")
def library(known):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def samples():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a\n\nb", "  x", "it's we'll 'tis 'S I'm", "\x85\xa0 x\x1c\x1d y", "a" * 5000, " " * 3000 + "x"]
    texts += ["ab" * 3000, "é" * 2000, "的" * 3000, "0" * 3000, "=" * 4097, "-=" * 999, "naïve ½ ²3 ªº µ"]
    signs = ["a", "the", " ", "\n", "  ", "é", "的", "1", "½", "'s", "'", ".", "!!", "\U0003d001", "ß", "ing", "՘", "\t", "Ⅷ", "<|endoftext|>"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    for _ in range(25):
        texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(200, 3000))))
        texts.append("".join(rng.choice(["th", "e", "in", "g", "er", "and"]) for _ in range(rng.randrange(200, 3000))))
        texts.append("".join(rng.choice("ab ") * rng.randrange(1, 90) for _ in range(rng.randrange(20, 100))))
    return texts


def test_texts(known, library):
    texts = samples()
    for text, ids in zip(texts, known.texts(texts), strict=True):
        assert numbers(ids) == library.encode_ordinary(text or "")
        assert known.decode(ids) == (text or "").encode()


def test_every_character(known, library):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a{c} {c}1{c}.{c}" for c in characters[k : k + 997]) for k in range(0, len(characters), 997)]
    for text, ids in zip(texts, known.texts(texts), strict=True):
        assert numbers(ids) == library.encode_ordinary(text)


def test_pieces_of_long_texts(known, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 64)
    for text in samples():
        ids, run = [], []
        for piece, stretch, goes_on in byte_bpe.cut(text or ""):
            if not goes_on:
                ids, run = ids + known.tree(run).tolist(), []
            found = next(known.texts([piece])) if stretch is None else known.stretches([stretch])[0]
            run.append(np.array(numbers(found), np.int32))
        assert ids + known.tree(run).tolist() == library.encode_ordinary(text or "")


def test_all_pairs_of_a_rank_at_once(known, library):
    rng = random.Random(4)
    for _ in range(60):
        plain = "".join(rng.choice(["a", "aa", "b", "the", "ing"]) for _ in range(rng.randrange(1, 400))).encode()
        row = known.bytes[np.frombuffer(plain, np.uint8)]
        assert known.merge_wide(row.copy()).tolist() == library._encode_single_piece(plain)


def test_tokens_encode_to_themselves_and_rank_above_their_parts(known):
    """What joints and merging a rank at once rely on."""
    plain = b"".join(known.tokens)
    sizes = np.array([len(t) for t in known.tokens])
    ids, counts = known.merged(known.bytes[np.frombuffer(plain, np.uint8)], sizes)
    assert (counts == 1).all() and ids.tolist() == list(range(len(known.tokens)))
    for rank, token in enumerate(known.tokens):
        if len(token) > 1:  # the last two parts before the token itself is merged
            below = {t: r for t, r in zip((token[:k] for k in range(1, len(token))), map(known.ranks.get, (token[:k] for k in range(1, len(token))))) if r is not None}
            assert any(r < rank and known.ranks.get(token[len(t) :], rank) < rank for t, r in below.items())


def test_remembered_matches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50_000)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 1000)
    known = byte_bpe.Vocabulary(byte_bpe.default_path())
    for _ in known.texts(f"w{i}x " * 3 + "q" * 4000 for i in range(2000)):
        assert len(known.known) < 1000 and all(len(m) <= byte_bpe.BRIEF for m in known.known)


def test_query(spark, make_docs, library):
    rows = [(1, None), (2, ""), (3, "One two"), (3, "One two"), (None, "x " * 100_000), (5, "ab" * 200_000), (6, " " * 90_000 + "é")]
    rows += [(10 + n, text) for n, text in enumerate(samples()[:40])]
    got = [tuple(r) for r in byte_bpe.digests(make_docs(rows)).collect()]
    expected = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        plain = sha256((text or "").encode()).hexdigest()
        expected.append((doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), plain))
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_columns(spark, make_docs, clashing):
    docs = clashing(make_docs([(1, "a b"), (2, "c" * 100_000), (3, None)]))
    rows = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert {(r.doc_id, bytes(r.decoded).decode(), r.size) for r in rows} == {(1, "a b", "x"), (2, "c" * 100_000, "x"), (3, "", "x")}
    assert byte_bpe.digests(make_docs([])).count() == 0
