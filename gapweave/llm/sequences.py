"""Token ids as Arrow files of equal-length sequences.

The ids of all documents, each closed by an end id, are one stream in ascending
order of the key.  Every range of that order is a file in the Arrow file format:
record batches with the columns ``ids`` and ``mask``, fixed-size lists of
``length`` values each, so that sequence i is found without reading others and is
seen in place when the file is mapped into memory.  The last sequence of a file is
filled up with zeros that the mask leaves out.  A second file lists the documents:
key, start within the file, number of ids with the end id.

Ids take two bytes if the vocabulary allows it, else four.  Order: key (nulls
first), then a hash of the text; equal rows stand in any order, and one key may
span several files.  Null texts are empty.  An empty table gives no files and no
rows.  Files are written through Arrow's file systems below the shared folder;
each attempt of a task writes its own, and only files that the written manifest
names are read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_over, scratch_dir
from .batches import prepare_texts
from .bpe import default_path, encoder
from .text import as_bytes

LENGTH = 2048
# sequences of one record batch
ROWS = 128
END_ID = 1


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that all executors reach, and the path in it."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class SequenceWriter:
    """Writes a stream of ids as sequences."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind = length, np.dtype(kind)
        item = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        full = self.length * ROWS
        if self.size >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) // full * full
            for k in range(0, whole, full):
                self._write(flat[k : k + full], full)
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (flat, mask)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.file.close()


class SequenceFile:
    """Random access to the sequences of a file; nothing is copied if the source is a memory map."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)

    def batch(self, n: int) -> np.ndarray:
        """All ids of a record batch, one after another."""
        return self.file.get_batch(n).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """The ids and the mask of sequence i."""
        batch = self.file.get_batch(i // ROWS)
        return batch.column("ids")[i % ROWS].values, batch.column("mask")[i % ROWS].values

    def spans(self, starts: list[int], sizes: list[int]) -> Iterator[np.ndarray]:
        """The ids of ascending spans of the stream."""
        n, flat, base = -1, np.zeros(0, np.uint16), 0
        for start, size in zip(starts, sizes):
            parts = []
            while size:
                while start >= base + len(flat):
                    base += len(flat)
                    n += 1
                    flat = self.batch(n)
                parts.append(flat[start - base : start - base + size])
                start, size = start + len(parts[-1]), size - len(parts[-1])
            yield np.concatenate(parts) if len(parts) != 1 else parts[0]


def _write_range(folder: str, path: str, length: int, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, nr = encoder(path), TaskContext.get().partitionId()
        kind = np.uint16 if max(len(enc.tokens) - 1, end_id) < 1 << 16 else np.uint32
        writer = docs = None
        end, rows = np.array([end_id], kind), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files, root = open_folder(folder)
                files.create_dir(root, recursive=True)
                name = f"{nr:06d}-{uuid.uuid4().hex}"
                sink, doc_sink = (files.open_output_stream(f"{root}/{name}{end}") for end in (".arrow", ".docs.arrow"))
                writer = SequenceWriter(sink, length, kind)
                schema = pa.schema([batch.schema.field("key"), ("start", pa.int64()), ("n_tokens", pa.int64())])
                docs = pa.ipc.new_file(doc_sink, schema)
            starts, sizes = [], []
            for text in as_bytes(batch.column("text")):
                starts.append(writer.total)
                writer.add(np.frombuffer(enc.text(text), "<u4"))
                writer.add(end)
                sizes.append(writer.total - starts[-1])
            docs.write_batch(pa.record_batch([batch.column("key"), pa.array(starts), pa.array(sizes)], schema=schema))
            rows += batch.num_rows
        if writer is not None:
            for w, s in ((writer, sink), (docs, doc_sink)):
                w.close()
                s.close()
            yield pa.RecordBatch.from_pylist([{"nr": nr, "name": name, "docs": rows, "tokens": writer.total}])

    return task


def write_sequences(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Write the files; the manifest ``nr, name, docs, tokens, start`` has a row for each, in order."""
    prepare_texts(docs.sparkSession)
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("at")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")
    write = _write_range(folder, path or default_path(), length, end_id)
    files = hand_over(ranges.mapInArrow(write, "nr long, name string, docs long, tokens long"))
    # one row per file
    before = Window.orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_files(folder: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for manifest in batches:
            for name, start in zip(manifest.column("name").to_pylist(), manifest.column("start").to_pylist()):
                with files.open_input_file(f"{root}/{name}.arrow") as f, files.open_input_file(f"{root}/{name}.docs.arrow") as g:
                    listed = pa.ipc.open_file(g).read_all()
                    starts, sizes = listed["start"].to_pylist(), listed["n_tokens"].to_pylist()
                    spans = SequenceFile(f).spans(starts, sizes)
                    sums = [zlib.crc32(s.astype("<u4").tobytes()) for s in spans]
                    yield pa.RecordBatch.from_arrays(
                        [
                            listed["key"].combine_chunks(),
                            pa.array([start + s for s in starts], pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["key", "start", "n_tokens", "ids_crc32"],
                    )

    return task


def read_documents(manifest: DataFrame, folder: str, key_type: str) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of each document, from the files."""
    n = max(manifest.count(), 1)
    return manifest.repartition(n, "name").mapInArrow(
        _read_files(folder), f"key {key_type}, start long, n_tokens long, ids_crc32 long"
    )


def op7(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    files = scratch_dir(spark)
    manifest = write_sequences(docs, files)
    key_type = docs.schema["doc_id"].dataType.simpleString()
    return read_documents(manifest, files, key_type).withColumnRenamed("key", "doc_id")
