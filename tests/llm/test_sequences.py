from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from gapweave.llm import bpe, sequences
from gapweave.session import scratch_dir


def expected(rows):
    library = Tokenizer.from_file(bpe.default_path())
    out, start = [], 0
    for doc, text in rows:
        e = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(e), zlib.crc32(e.tobytes())))
        start += len(e)
    return out


def result(spark, docs):
    folder = scratch_dir(spark)
    manifest = sequences.write_sequences(docs, folder, length=16)
    found = sequences.read_documents(manifest, folder, "long")
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])


def test_files_hold_all_ids_in_order(spark, make_docs, clashing):
    rows = [(None, "no id"), (-5, None), (1, ""), (2, "some words " * 3000), *[(i, f"text {i}, more") for i in range(3, 300)]]
    assert result(spark, clashing(make_docs(rows[::-1]))) == expected(rows)


def test_repeated_ids_stand_side_by_side(spark, make_docs):
    rows = [(1, "a"), *[(2, "same text")] * 30, (3, "b")]
    assert result(spark, make_docs(rows)) == expected(rows)


def test_no_rows(spark, make_docs):
    assert result(spark, make_docs([])) == []


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted((tuple(r) for r in sequences.op7(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected([tuple(r) for r in docs])


def test_random_access_without_copies(tmp_path):
    stream = np.arange(5000) % 60000
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as sink:
        writer = sequences.SequenceWriter(sink, 16, np.uint16)
        for part in np.array_split(stream, 7):
            writer.add(part)
        writer.close()
    with pa.memory_map(str(tmp_path / "x.arrow")) as source:
        before = pa.total_allocated_bytes()
        f = sequences.SequenceFile(source)
        ids, mask = f.sequence(200)
        assert ids.to_numpy().tolist() == stream[3200:3216].tolist() and all(mask.to_pylist())
        ids, mask = f.sequence(312)
        assert mask.to_pylist() == [True] * 8 + [False] * 8
        assert pa.total_allocated_bytes() - before < 4096
