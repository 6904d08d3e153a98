"""Benchmark passages in a corpus, found by a positional inverted index.

The corpus is read once.  Every word that some benchmark item uses gives a
posting ``(document, term, position)`` with a short signature of either neighbour;
the postings are written to the shared folder.  A window is ``width`` consecutive words of an item (an item of fewer
words is one window).  For each window the terms that are rarest in the corpus
are looked up: a posting at position p of a term that stands at offset o of the
window, with the window's neighbours beside it, speaks for a start at p - o, and
only starts that all the rare terms agree on are checked against the remaining
terms.

Words are maximal runs of 0-9, a-z and all non-ASCII characters after A-Z has
been lower-cased.  Null texts and texts without words have no words and no hits;
null and wordless items have no windows.  Rows that share ``doc_id`` are told
apart by a hash of their text, rows equal in both get equal results.  Repeated
items count as often as they have different ids.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_over, prepare

# Fixed by the contract: what separates words, one by one so that the pattern is a bit set.
SEPARATORS = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The posting of this term (no word is empty) gives the number of words of its document.
END = ""
RARE = 3
# At most so many rows are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def fold(text: str | Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: str) -> Column:
    """The words of a text as an array, lower-cased."""
    return F.filter(F.split(fold(text), SEPARATORS), lambda w: w != "")


def item_windows(items: DataFrame, width: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """``window, n, item, offset, term``: the words of each distinct window of each item."""
    listed = items.select(F.col(item).alias("item"), words(text).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    cut = listed.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("w")).distinct()
    return cut.select(
        F.concat_ws(" ", "w").alias("window"), F.size("w").alias("n"), "item", F.posexplode("w").alias("offset", "term")
    )


def few(df: DataFrame, rows: int) -> DataFrame:
    """Marked for a broadcast if it has been counted to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bit(rank) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), rank)


def all_bits(n) -> Column:
    """The bits of ranks 1 to n."""
    return bit(n + 1) - 2


def signature(word: Column) -> Column:
    """Sixteen bits of a word, alike for all its spellings in upper and lower case."""
    return (F.xxhash64(F.lower(word)).bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short")


def build_index(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the postings ``doc_id, text_hash, term, pos, before, after`` of all terms in ``vocabulary(term)``."""
    terms = vocabulary.select("term").union(docs.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    known = hand_over(terms.select("term", F.lower("term").alias("key")))
    content = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        # a last word of our own: its position is the number of words before it
        F.split(F.concat(content, F.lit(" end")), SEPARATORS).alias("parts"),
    )
    rows = parts.select(
        "doc_id",
        "text_hash",
        "parts",
        (F.size("parts") - 1).alias("_last"),
        F.when(F.element_at("parts", 1) == "", 1).otherwise(0).alias("_lead"),
        F.posexplode("parts").alias("_at", "_part"),
    )
    is_end = F.col("_at") == F.col("_last")
    keyed = rows.withColumn("key", F.when(is_end, "").when(F.col("_part") == "", None).otherwise(F.lower("_part")))
    # lower() also changes letters beyond A-Z; where there are any, compare exactly
    at = F.col("_at")
    keyed = keyed.withColumns({"before": signature(F.get("parts", at - 1)), "after": signature(F.get("parts", at + 1))})
    ascii = F.octet_length("_part") == F.length("_part")
    same = is_end | F.when(ascii, F.lower("_part") == F.col("term")).otherwise(fold("_part") == F.col("term"))
    postings = keyed.drop("parts").join(few(known, known.count()), "key").filter(same)
    return hand_over(postings.select("doc_id", "text_hash", "term", (at - F.col("_lead")).alias("pos"), "before", "after"))


def _rank_terms(index: DataFrame, windows: DataFrame) -> DataFrame:
    """The terms of each window with their neighbours' signatures, ranked by how rare they are in the corpus."""
    seen = index.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    terms = windows.select("window", "n", "offset", "term").distinct()
    rarity = Window.partitionBy("window").orderBy("seen", "offset")  # a window has at most ``width`` rows
    counted = terms.join(seen, "term", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    place = Window.partitionBy("window").orderBy("offset")
    return counted.withColumns(
        {
            "rank": F.row_number().over(rarity),
            "_before": signature(F.lag("term").over(place)),
            "_after": signature(F.lead("term").over(place)),
        }
    ).withColumns({"_before": F.when(F.col("offset") > 0, F.col("_before")), "_after": F.when(F.col("offset") < F.col("n") - 1, F.col("_after"))})


def _rare_starts(index: DataFrame, ranked: DataFrame, beside: bool = True) -> DataFrame:
    """A row for each posting of a rare term: the start of the window that it speaks for.

    With ``beside`` the window's neighbours of the term must stand beside it.
    """
    rare = ranked.filter(F.col("rank") <= RARE)
    spoken = index.join(few(rare, rare.count()), "term")
    if beside:
        for own, wanted in (("before", "_before"), ("after", "_after")):
            spoken = spoken.filter(F.col(wanted).isNull() | (F.col(own) == F.col(wanted)))
    return spoken.select(
        "doc_id", "text_hash", "window", "n", "rank", (F.col("pos") - F.col("offset")).alias("start")
    )


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, window, n, start``: every place where a whole window stands."""
    ranked = hand_over(_rank_terms(index, windows))
    where = ["doc_id", "text_hash", "window", "n", "start"]
    agreed = (
        _rare_starts(index, ranked)
        .groupBy(*where)
        .agg(F.bit_or(bit(F.col("rank"))).alias("mask"))
        .filter(F.col("mask") == all_bits(F.least("n", F.lit(RARE))))
        .drop("mask")
    )
    agreed = hand_over(agreed)
    expected = agreed.join(ranked.select("window", "offset", "term", "rank"), "window").select(
        *where, "term", "rank", (F.col("start") + F.col("offset")).alias("pos")
    )
    # only documents with such a start matter from here on
    open_docs = agreed.select("doc_id", "text_hash").distinct()
    p, e, d = index.alias("p"), expected.alias("e"), few(open_docs, open_docs.count()).alias("d")
    p = p.join(d, F.expr("p.doc_id <=> d.doc_id AND p.text_hash = d.text_hash"), "left_semi")
    same_place = F.expr("p.doc_id <=> e.doc_id AND p.text_hash = e.text_hash AND p.term = e.term AND p.pos = e.pos")
    return (
        p.join(e, same_place)
        .groupBy(*[F.col(f"e.{c}").alias(c) for c in where])
        .agg(F.bit_or(bit(F.col("e.rank"))).alias("mask"))
        .filter(F.col("mask") == all_bits(F.col("n")))
        .drop("mask")
    )


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int = 5) -> DataFrame:
    """Places where the rare terms of a window stand, but shifted by up to ``slop`` words.

    ``doc_id, text_hash, window, start, spread``: a start that a rare term speaks
    for, and how far behind it the others have theirs (0 where the rare terms stand
    exactly as in the window).
    """
    starts = _rare_starts(index, _rank_terms(index, windows), beside=False)
    # each start against those of the ``slop`` words behind it
    near = Window.partitionBy("doc_id", "text_hash", "window").orderBy("start").rangeBetween(0, slop)
    nearest = [F.min(F.when(F.col("rank") == r, F.col("start"))).over(near) for r in range(1, RARE + 1)]
    return (
        starts.withColumns({"mask": F.bit_or(bit(F.col("rank"))).over(near), "spread": F.greatest(*nearest) - F.col("start")})
        .filter(F.col("mask") == all_bits(F.least("n", F.lit(RARE))))
        .select("doc_id", "text_hash", "window", "start", "spread")
        .distinct()
    )


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_hit, items``.

    ``n_hit`` counts the words that lie inside some occurrence of a window,
    ``items`` are the items with such windows.
    """
    prepare(docs.sparkSession)
    windows = hand_over(item_windows(items, width))
    index = build_index(docs, windows, doc_id, text)
    found = hand_over(phrase_matches(index, windows))
    ids = ["doc_id", "text_hash"]
    covered = (
        found.select(*ids, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos"))
        .distinct()
        .groupBy(*ids)
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        found.select(*ids, "window")
        .distinct()
        .join(windows.select("window", "item").distinct(), "window")
        .groupBy(*ids)
        .agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    )
    lengths = index.filter(F.col("term") == END).select(*ids, F.col("pos").cast("long").alias("n_words"))

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
        met = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        return left.join(right, met, "left").drop("_id", "_hash")

    return add(add(lengths, covered), named).select(
        *ids,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("items"),
    )


def without_leaks(
    docs: DataFrame, items: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    prepare(docs.sparkSession)
    windows = hand_over(item_windows(items, width))
    index = build_index(docs, windows, doc_id, text)
    found = hand_over(phrase_matches(index, windows).select("doc_id", "text_hash").distinct())
    found = found.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    known = docs.withColumn("_own", F.xxhash64(text))
    met = known[doc_id].eqNullSafe(found["_doc"]) & (known["_own"] == found["_hash"])
    return known.join(few(found, found.count()), met, "left_anti").select(*docs.columns)


def op10(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = """
WITH w AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), d AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''), []) AS w FROM documents
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM w WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (SELECT DISTINCT doc_id, g.n, s, item_id FROM grams g JOIN win USING (n, phrase)
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::varchar)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
