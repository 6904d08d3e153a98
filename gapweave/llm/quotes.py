"""Conversations in reply order, without quoted text, by linking quotations to their originals.

A line that begins with one or more ``>`` is quoted at that level; a passage is a
run of quoted lines of one level, ended by an empty quoted line.  A line that
announces a quotation ("... wrote:") goes with it.  What is left is the message's
own text, its body.

Passages are compared in units: the whole passage, its lines and its sentences,
each in lower case with white space collapsed, as hashes.  Own texts give the same
units, and their paragraphs.  The original of a unit is the first message of the
conversation that has it as its own; a unit thus has one original, however often
it is used.  The message that a passage quotes is the earlier one that is the
original of most of its letters (the later message on a tie), and the parent of a
message is what its first-level quotations quote most.

Order of a conversation: messages without a parent by turn, each followed by the
replies below it, nearer ones first, then by turn.  Rows equal in conversation,
turn, role and text are one message; messages of one turn are told apart by their
hash.  A null conversation is one of its own, a null turn comes first, a null text
is empty and quotes nothing.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hand_over
from .batches import prepare_texts

QUOTED = re.compile(r"\s*((?:>[ \t]?)+)(.*)")
ANNOUNCES = re.compile(r"\s*\S.*\b(wrote|said|schrieb|a écrit|escribió)\s*:\s*")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
# turns that are numbered by one task
SLICE = 4096


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def units(lines: list[str]) -> dict[int, int]:
    """Hashes of the whole, the lines and the sentences of a text, and their lengths."""
    whole = " ".join(lines)
    parts = {normal(p) for p in (whole, *lines, *SENTENCE.split(whole))}
    return {xxhash.xxh3_64_intdigest(p.encode()) - (1 << 63): len(p) for p in parts if p}


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The body of a message, and its quoted passages as level and lines."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level = 0
    for line in text.split("\n"):
        m = QUOTED.match(line)
        if not m:
            level = 0
            body.append(line)
            continue
        if level == 0 and body and ANNOUNCES.fullmatch(body[-1]):
            body.pop()
        now, content = m[1].count(">"), m[2].strip()
        if not content:
            level = -1  # the passage ends, not the quotation
            continue
        if now != level:
            passages.append((now, []))
        passages[-1][1].append(content)
        level = now
    return "\n".join(body).strip(), passages


UNIT = T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.IntegerType())])
QUOTE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("passage", T.StringType()), T.StructField("units", T.ArrayType(UNIT))])
PARSED = T.StructType([T.StructField("body", T.StringType()), T.StructField("own", T.ArrayType(UNIT)), T.StructField("quotes", T.ArrayType(QUOTE))])
_unit = pa.struct([("hash", pa.int64()), ("n", pa.int32())])
_quote = pa.struct([("level", pa.int32()), ("passage", pa.string()), ("units", pa.list_(_unit))])
_parsed = pa.struct([("body", pa.string()), ("own", pa.list_(_unit)), ("quotes", pa.list_(_quote))])


def _listed(found: dict[int, int]) -> list[dict]:
    return [{"hash": h, "n": n} for h, n in found.items()]


@F.arrow_udf(PARSED)
def parsed(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        body, passages = parse(text or "")
        own: dict[int, int] = {}
        for paragraph in re.split(r"\n[ \t]*\n", body):
            own |= units(paragraph.split("\n"))
        own |= units(body.split("\n"))
        quotes = [{"level": n, "passage": "\n".join(p), "units": _listed(units(p))} for n, p in passages]
        out.append({"body": body, "own": _listed(own), "quotes": quotes})
    return pa.array(out, _parsed)


def messages(conversations: DataFrame) -> DataFrame:
    """The distinct messages with a number, parsed and written."""
    prepare_texts(conversations.sparkSession)
    own = conversations.select("conv_id", "turn", "role", "text").distinct()
    numbered = own.withColumn("id", F.xxhash64(F.isnull("conv_id"), "conv_id", F.isnull("turn"), "turn", "role", "text"))
    return hand_over(numbered.withColumn("p", parsed.asNondeterministic()("text")).select("conv_id", "turn", "role", "id", "p.*"))


def _place() -> list:
    return [F.col("turn").asc_nulls_first(), "id"]


def quotation_links(said: DataFrame) -> DataFrame:
    """``id, passage_nr, level, passage, source``: each quoted passage and the message it is from, if found."""
    key = F.xxhash64(F.isnull("conv_id"), "conv_id").alias("conv")
    place = F.struct(F.isnotnull("turn").alias("some"), "turn", "id")
    own = said.select(key, place.alias("place"), F.explode("own").alias("u"))
    originals = own.groupBy("conv", F.col("u.hash").alias("hash")).agg(F.min("place").alias("from"))
    passages = said.select(key, place.alias("place"), F.posexplode("quotes").alias("passage_nr", "q"))
    used = passages.select("conv", "place", "passage_nr", F.explode("q.units").alias("u"))
    met = used.select("*", F.col("u.hash").alias("hash")).join(originals, ["conv", "hash"]).filter(F.col("from") < F.col("place"))
    best = (
        met.groupBy(F.col("place.id").alias("id"), "passage_nr", "from")
        .agg(F.sum("u.n").alias("n"))
        .groupBy("id", "passage_nr")
        .agg(F.max(F.struct("n", "from")).alias("best"))
    )
    every = passages.select(F.col("place.id").alias("id"), "passage_nr", "q.level", "q.passage")
    return every.join(best, ["id", "passage_nr"], "left").select(
        "id", "passage_nr", "level", "passage", F.col("best.from.id").alias("source"), F.col("best.from").alias("_from"), F.col("best.n").alias("_n")
    )


def _roots(parents: DataFrame) -> DataFrame:
    """``id, root, depth`` of every message that has a parent, by doubling the reach of each step."""
    reach = hand_over(parents.select("id", F.col("parent").alias("above"), F.lit(1).cast("long").alias("depth")))
    while True:
        a, b = reach.alias("a"), reach.alias("b")
        further = hand_over(
            a.join(b, F.col("a.above") == F.col("b.id"), "left").select(
                "a.id",
                F.coalesce("b.above", "a.above").alias("above"),
                (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
            )
        )
        moved = reach.alias("x").join(further.alias("y"), "id").filter("x.above <> y.above").limit(1).count()
        reach = further
        if not moved:
            return reach.withColumnRenamed("above", "root")


def reply_order(said: DataFrame, links: DataFrame) -> DataFrame:
    """``conv_id, turn, role, id, parent, depth, position, body``, a row for each message."""
    first = links.filter((F.col("level") == 1) & F.col("source").isNotNull())
    parents = (
        first.groupBy("id", "source", "_from")
        .agg(F.sum("_n").alias("n"))
        .groupBy("id")
        .agg(F.max(F.struct("n", "_from")).alias("best"))
        .select("id", F.col("best._from.id").alias("parent"))
    )
    parents = hand_over(parents)
    tree = _roots(parents).join(parents, "id")
    turns = said.select(F.col("id").alias("root"), F.col("turn").alias("root_turn"))
    placed = (
        said.select("conv_id", "turn", "role", "id", "body", F.size("quotes").alias("n_quotes"))
        .join(tree, "id", "left")
        .withColumns({"root": F.coalesce("root", "id"), "depth": F.coalesce("depth", F.lit(0))})
        .join(turns, "root")
    )
    # number the messages of a conversation slice by slice, so that none is too long for a task
    placed = hand_over(placed.withColumn("_slice", F.coalesce(F.floor(F.col("root_turn") / SLICE), F.lit(-(1 << 62)))))
    sizes = placed.groupBy("conv_id", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnsRenamed({"conv_id": "_conv", "_slice": "_s"})
    inside = Window.partitionBy("conv_id", "_slice").orderBy(
        F.col("root_turn").asc_nulls_first(), "root", "depth", *_place()
    )
    ranked = placed.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_slice") == F.col("_s"))).select(
        "conv_id",
        "turn",
        "role",
        "id",
        "parent",
        "root",
        "depth",
        (F.col("_before") + F.col("_rank") - 1).alias("position"),
        "n_quotes",
        "body",
    )


def chat_lines(ordered: DataFrame) -> DataFrame:
    """``ordered`` with each message as a chat line: its role in marks, its body, an end mark."""
    role = F.coalesce("role", F.lit("user"))
    return ordered.withColumn("chat", F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n")))


def conversations(table: DataFrame) -> DataFrame:
    said = messages(table)
    return chat_lines(reply_order(said, hand_over(quotation_links(said))))


def op6(spark, folder: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{folder}/conversations.parquet"))
