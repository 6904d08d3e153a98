"""How filters on texts interact, counted on a stream that takes back what it counted.

Five filters judge every text; a row's mask has a bit for each one that it fails:

* A: under 50 words; B: distinct words under 65 % of the words; C: A-Z over 5 % of the code points;
  D: one of ``#$%&*|``; E: a row of smaller id has the same text, kept or not.
  Words are runs other than ASCII white space, case matters, a null text is empty.

The files of the table arrive in micro-batches.  A to D come from the text alone, and a
row is first counted with these in its part.  E depends on all other rows: the state of
each text (by its 128-bit digest) is the least id met so far and how the rows of that id
were counted.  Rows above the least id are taken back from the counter they went to and
counted with E.  When a smaller id arrives, the rows of the former least one are taken
back and counted with E as well.  So after every batch the counters hold what a whole
run over the files so far would give, whatever their order.

Within a task, rows of one text are put together before they are shuffled, so that a
text with a third of all rows sends a short list from each task.  A batch adds its
changes to the counters in a folder of its own; a batch that is run again overwrites it.

Every order of the five filters follows from the counters of a part: the rows kept after
any set of filters are those whose mask has none of them.

* Null ids count as larger than all others; rows of one id and text don't fail E by each other.
* A null source is the part "", like an empty one.  Ids without a label are neither good nor toxic;
  of several labels of an id one that marks it is enough.
* An empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import hand_over, scratch_dir
from ..streaming.streams import batch_writer, each_batch, read_stream
from .batches import prepare_texts

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "[#$%&*|]"

# Micro-batches that a table is read in, if it has as many files.
BATCHES = 4
# Texts of the whole table that share a key of the state store.
BUCKET = 500
# Rows of a table up to which the session's own state store holds all texts (about 100 bytes each).
# One on disk sets aside some MB for each of its partitions, which is more than a small state takes.
IN_MEMORY = 20_000_000
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# Rows that a task puts together before it hands them on.
TOGETHER = 200_000
LARGEST = 2**63 - 1


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, salt, part, digest, mask`` of rows; ``salt`` spreads null ids over a join."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n, points = F.size("words"), F.length("text")
    letters = points - F.length(F.translate("text", UPPER, ""))
    fails = {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct("words")) < 65 * n,
        "C": 100 * letters.cast("long") > 5 * points,
        "D": F.col("text").rlike(SIGNS),
    }
    mask = sum((F.when(failed, 1 << FILTERS.index(f)).otherwise(0) for f, failed in fails.items()), F.lit(0))
    salt, digest = F.floor(F.rand(7) * 2**60), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)
    return rows.select("doc_id", salt.alias("salt"), "part", digest.alias("digest"), mask.alias("mask"))


GATHERED = "bucket long, digest string, least long, mask int, counts string"
CHANGES = "part string, mask int, good boolean, toxic boolean, n long"
STATE = "texts string"


def _gathered(buckets: int):
    """Rows of a text as one: the least id and ``counts`` of [part, good, toxic, rows, rows of the least id].

    Beside them, without a digest, the rows of each counter as they arrive.
    """

    def flush(texts: dict[str, list], arrived: dict[tuple, int]) -> pa.RecordBatch:
        rows = [
            (int(digest[:16], 16) % buckets, digest, least, failed, json.dumps([[*kind, *n] for kind, n in kinds.items()]))
            for digest, (least, failed, kinds) in texts.items()
        ]
        for (failed, *kind), n in arrived.items():
            bucket = xxhash.xxh3_64_intdigest(f"{failed} {kind}") % buckets
            rows.append((bucket, None, 0, failed, json.dumps([[*kind, n, 0]])))
        names = ["bucket", "digest", "least", "mask", "counts"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list] = {}
        arrived: dict[tuple, int] = defaultdict(int)
        held = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("digest", "doc_id", "mask", "part", "good", "toxic")]
            for digest, doc_id, failed, part, good, toxic in zip(*columns):
                doc_id = LARGEST if doc_id is None else doc_id
                entry = texts.get(digest)
                if entry is None:
                    entry = texts[digest] = [doc_id, failed, {}]
                if doc_id < entry[0]:
                    entry[0] = doc_id
                    for n in entry[2].values():
                        n[1] = 0
                n = entry[2].setdefault((part, good, toxic), [0, 0])
                n[0] += 1
                n[1] += doc_id == entry[0]
                arrived[failed, part, good, toxic] += 1
            held += batch.num_rows
            if held >= TOGETHER:
                yield flush(texts, arrived)
                texts.clear()
                arrived.clear()
                held = 0
        if held:
            yield flush(texts, arrived)

    return task


def _met(known: list | None, least: int, counts: list) -> tuple[list, list]:
    """A text's state after rows of it have come, and how many rows of each kind now fail E.

    The state is the least id and the rows of it by kind; these are the ones counted without E.
    """
    now, late = {}, []
    if known is None or least < known[0]:
        late += known[1] if known else []
    elif least > known[0]:
        least, now = known[0], {tuple(kind): n for *kind, n in known[1]}
        counts = [[*kind, n, 0] for *kind, n, _ in counts]
    else:
        now = {tuple(kind): n for *kind, n in known[1]}
    for *kind, n, firsts in counts:
        if firsts:
            now[tuple(kind)] = now.get(tuple(kind), 0) + firsts
        if n > firsts:
            late.append([*kind, n - firsts])
    return [least, [[*kind, n] for kind, n in now.items()]], late


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes to the counters that new rows of a bucket's texts make."""
    texts = json.loads(state.get[0]) if state.exists else {}
    changes: dict[tuple, int] = defaultdict(int)
    for frame in frames:
        for digest, least, failed, counts in zip(*[frame[c].tolist() for c in ("digest", "least", "mask", "counts")]):
            counts = json.loads(counts)
            if digest is None:  # rows as they arrive
                for part, good, toxic, n, _ in counts:
                    changes[part, failed, good, toxic] += n
                continue
            texts[digest], late = _met(texts.get(digest), least, counts)
            for part, good, toxic, n in late:
                changes[part, failed, good, toxic] -= n
                changes[part, failed | COPY, good, toxic] += n
    state.update((json.dumps(texts),))
    if changes:
        yield pd.DataFrame([(*kind, n) for kind, n in changes.items()], columns=["part", "mask", "good", "toxic", "n"])


def labelled(labels: DataFrame) -> DataFrame:
    """``l_id, good, toxic`` for the ids that are one of both."""
    marks = labels.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    return hand_over(marks.filter("l_id IS NOT NULL AND (good OR toxic)"))


def changes(docs: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """The changes to the counters ``part, mask, good, toxic`` that a stream of documents makes."""
    rows = judged(docs)
    # null ids are spread, and meet nobody
    own = F.when(F.col("doc_id").isNull(), F.col("salt")).otherwise(F.col("doc_id"))
    known = F.col("_own").eqNullSafe(F.col("l_id")) & F.col("doc_id").isNotNull()
    met = rows.withColumn("_own", own).join(marks, known, "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    gathered = met.select("digest", "doc_id", "mask", "part", *flags).mapInArrow(_gathered(buckets), GATHERED)
    return gathered.groupBy("bucket").applyInPandasWithState(_update, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that hold while a stream runs."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, in_memory: int = IN_MEMORY) -> DataFrame:
    """``part, mask, good, toxic, n`` of all files of a table, read as a stream of ``batches`` micro-batches.

    Beyond ``in_memory`` rows the state is kept on the executors' disks, whatever store the session names.
    """
    prepare_texts(spark)
    table = spark.read.parquet(path).select("doc_id", "text", "source")
    files = -(-len(table.inputFiles()) // batches)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table.count() // BUCKET)
    found = changes(read_stream(spark, path, table.schema, max(files, 1)), labelled(labels), buckets)
    folder = scratch_dir(spark)
    spark.createDataFrame([], CHANGES).write.parquet(f"{folder}/batch=none")  # a table without files has no batch
    kinds = ["part", "mask", "good", "toxic"]
    write = batch_writer(folder)

    def add(rows: DataFrame, batch_id: int) -> None:
        write(rows.groupBy(*kinds).agg(F.sum("n").alias("n")), batch_id)

    with _settings(spark, ON_DISK if table.count() > in_memory else {}):
        each_batch(found, add)
    return spark.read.schema(CHANGES).parquet(folder).groupBy(*kinds).agg(F.sum("n").alias("n")).filter("n != 0")


def _kept(failed: int, wanted: Column | None = None) -> Column:
    """Rows whose mask has none of a set of filters."""
    inside = F.col("mask").bitwiseAND(F.lit(failed)) == 0
    return F.sum(F.when(inside if wanted is None else inside & wanted, F.col("n")).otherwise(0))


def interactions(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step of it."""
    sets, n = range(1 << len(FILTERS)), len(FILTERS)
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    parts = counted.groupBy("part").agg(
        F.array(*[_kept(s) for s in sets]).alias("left"),
        F.array(*[_kept(s, F.col("good")) for s in sets]).alias("good"),
        F.array(*[_kept(s, F.col("toxic")) for s in sets]).alias("toxic"),
        F.array(*[F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)) for b in bit.values()]).alias("unique"),
    )
    # by filter: of how many orders each set of other filters is the beginning, times what the filter then removes
    shapley = [
        sum(
            (F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) * (F.col("left")[s] - F.col("left")[s | b]) for s in sets if not s & b),
            F.lit(0),
        )
        for b in bit.values()
    ]
    steps = [
        (order, k + 1, sum(bit[f] for f in order[:k]), sum(bit[f] for f in order[: k + 1]), bit[order[k]], FILTERS.index(order[k]))
        for order in map("".join, permutations(FILTERS))
        for k in range(n)
    ]
    step = "array<struct<filter_order:string,step:int,before:int,after:int,own:int,filter:int>>"
    listed = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "before", "after", "own", "filter"), s)) for s in steps])), step)
    rows = parts.withColumn("shapleys", F.array(*shapley)).withColumn("s", F.explode(listed)).select("*", "s.*")

    def lost(kind: str) -> Column:
        return F.col(kind)[F.col("before")] - F.col(kind)[F.col("after")]

    alone = F.element_at("left", 1) - F.col("left")[F.col("own")]  # all that fail the filter
    columns = {
        "kept": F.col("left")[F.col("after")],
        "removed": lost("left"),
        "redundant": alone - lost("left"),
        "unique_fails": F.col("unique")[F.col("filter")],
        "good_lost": lost("good"),
        "toxic_lost": lost("toxic"),
        "shapley": F.col("shapleys")[F.col("filter")],
    }
    return rows.select("part", "filter_order", "step", *[c.cast("long").alias(name) for name, c in columns.items()])


def op12(spark, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return interactions(hand_over(counters(spark, f"{folder}/documents.parquet", labels)))


OP12_SQL = r"""
WITH marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         coalesce(doc_id, 9223372036854775807) AS place FROM documents
), masks AS (
  SELECT part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN place > min(place) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, step::INT AS step, (SELECT bit FROM letters WHERE letter = filter_order[step]) AS own,
         coalesce((SELECT sum(bit) FROM letters WHERE contains(filter_order[1:step - 1], letter)), 0)::BIGINT AS before
  FROM orders, range(1, 6) r(step)
), stepped AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & own != 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before != 0 AND mask & own != 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & own != 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own != 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM stepped
"""
