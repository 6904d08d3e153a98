from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gapweave.llm import bpe

PATH = bpe.default_path()
SIGNS = list("abcdefgst'’.,!<|>0129ABCÉÈéèçñßœŒİıſŸſ½²日本Σσς́̈ ​  \x1c\x85\x00\nKﬁ😀") + [
    "<|endoftext|>", "<|startoftext|>", "'re", "'LL", "<|ENDOFTEXT|>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def encoder():
    return bpe.Encoder(PATH)


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_random_texts(library, encoder):
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choices(SIGNS, k=rng.randint(0, 30)))
        expected = library.encode(text, add_special_tokens=False).ids
        got = encoder.text(text.encode())
        assert ids(got) == expected, text
        assert encoder.decode(got).decode() == library.decode(expected, skip_special_tokens=False)


def test_tree_concatenation(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 16)
    rng = random.Random(2)
    for _ in range(400):
        signs = rng.choice(["ab", "thereinstdonhgi", "é日x", "!?.", "a", "abcdefghijklmnopqrstuvwxyz"])
        text = "".join(rng.choices(signs, k=rng.randint(1, 700)))
        expected = library.encode(text, add_special_tokens=False).ids
        encoder.stretches.clear()
        assert ids(encoder.text(text.encode())) == expected
        parts = [(np.array(encoder.stretch(s), "<u4").tobytes() if p is None else encoder.text(p), g) for p, s, g in bpe.cut(text.encode(), encoder)]
        assert ids(bpe.tree(parts, encoder)) == expected


def test_forgetting_words_changes_nothing(library):
    encoder = bpe.Encoder(PATH, remembered=7)
    text = " ".join(f"word{i % 23} and, so on" for i in range(200))
    assert ids(encoder.text(text.encode())) == library.encode(text, add_special_tokens=False).ids


def test_whole_texts_on_spark(library, make_docs, clashing):
    unsplit = "".join(random.Random(4).choices("thereinstdonhgi", k=90_000))
    rows = [(1, "Hello, world"), (1, "Hello, world"), (2, None), (3, ""), (4, unsplit), (5, "it's " * 40_000 + unsplit + "!" * 5000), (None, "x"), (6, " " * 70_000)]
    got = bpe.digests(clashing(make_docs(rows))).collect()

    def expected(text):
        e = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(e, skip_special_tokens=False).encode()
        return len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *expected(t))) for i, t in rows)


def test_decode_gives_the_text_back(make_docs, library):
    docs = bpe.decode(bpe.encode(make_docs([(1, "Some words, 12!"), (2, None)])))
    got = {r.doc_id: r.decoded for r in docs.collect()}
    assert got == {1: library.decode(library.encode("Some words, 12!", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}


def test_no_rows(make_docs):
    assert bpe.digests(make_docs([])).collect() == []


def test_a_word_is_made_once(encoder, monkeypatch):
    """A stretch that is a word of its own, or part of several, is remembered once."""
    fresh, made = bpe.Encoder(PATH), []
    whole = fresh._stretch_bytes
    monkeypatch.setattr(fresh, "_stretch_bytes", lambda plain: made.append(plain) or whole(plain))
    assert fresh.text("stone stone. STONE!! stone&&& élan Élan, it's".encode()) == encoder.text("stone stone. stone!! stone&&& élan élan, it's".encode())
    assert len(made) == len(set(made)) and not fresh.words.old
    assert {"stone", "élan", "!!", "'s"} <= {k.decode() for k in fresh.words} and fresh.words is fresh.stretches
