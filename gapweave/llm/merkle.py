"""Merkle manifest of a table, with proofs from checkpoints of a few levels.

A leaf is the digest of a row's columns.  The leaves of a key stand in the order of
their id; every ``FAN`` consecutive nodes of a level make a node of the next one until
one is left, the key's subroot.  The subroots, in the order of their keys, make the
root the same way.

Only every ``STRIDE``-th level is written.  A node there, its descendants on the stored
level below and the levels between form an aligned subtree of at most FAN ** STRIDE
stored descendants.  To give proofs, a subtree's missing levels are made again from its
stored descendants, the siblings on the way up are read off them, put before those of
the subtree's own top, and the levels are forgotten.  So a tree of any size is built
and proved by shuffles of short bounded groups, none of them larger for a frequent key.

* A column of a leaf is ``-`` if null, else its number of UTF-8 bytes, ``:`` and the
  value; digests are SHA-256 in lower-case hexadecimal and are hashed as that text.
* Order: id (nulls first), then leaf.  Rows equal in both have equal leaves and are told
  apart by place only.  Null is a key of its own and comes first; keys follow by bytes.
* An empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_over, prepare
from .shards import RANGE_ROWS

FAN, STRIDE = 8, 2
SPAN = FAN**STRIDE
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SIBLINGS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A column as part of a leaf."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def _numbered(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows with ``idx``, their place in the key from 0, and ``n``, how many the key has.

    Rows are written in ranges of key and order; a frequent key covers many of them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, "_at"]
    at_hand = hand_over(rows)  # counted and sampled before it is put into ranges
    ranged = hand_over(
        at_hand.withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange(max(parts, -(-at_hand.count() // RANGE_ROWS)), *by)
        .sortWithinPartitions(*by)
        .drop("_at")
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # a row for each range and key in it
    parts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_from"))
    key = Window.partitionBy(*keys)
    before = F.sum("_rows").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_range").alias("_r"),
        (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_shift"),
        F.sum("_rows").over(key).alias("n"),
    )
    met = F.col("_range") == F.col("_r")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return ranged.join(parts, met).withColumn("idx", F.col("_place") + F.col("_shift")).drop("_range", "_place", "_r", "_shift", *[f"_{k}" for k in keys])


def _above(nodes: Column) -> Column:
    """The next level over consecutive nodes of a subtree."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(nodes, r * FAN + 1, FAN), "")))


def _subtrees(stored: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """A row for each subtree over a stored level: ``g``, ``n`` nodes on that level, ``l0`` .. with its levels.

    ``l0`` are the stored descendants, the last level has the top.  Where a whole key has fewer nodes,
    the levels above its subroot repeat it.
    """
    entry = F.struct("idx", "node", *carried)
    grouped = stored.groupBy(*keys, F.floor(F.col("idx") / SPAN).alias("g")).agg(F.array_sort(F.collect_list(entry)).alias("own"), F.first("n").alias("n"))
    levels = grouped.withColumn("l0", F.col("own.node"))
    for k in range(STRIDE):
        made = F.when(F.col("n") > FAN**k, _above(F.col(f"l{k}"))).otherwise(F.col(f"l{k}"))
        levels = levels.withColumn(f"l{k + 1}", made)
    return levels


def _siblings(place: Column) -> Column:
    """The siblings of a node at ``place`` of a subtree on each of its levels."""
    found = []
    for k in range(STRIDE):
        at = F.floor(place / FAN**k).cast("int")
        level, first = F.col(f"l{k}"), at - at % FAN
        left = F.array_join(F.slice(level, first + 1, at % FAN), "")
        right = F.array_join(F.slice(level, at + 2, F.lit(FAN - 1) - at % FAN), "")
        found.append(F.when(F.col("n") > FAN**k, F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*found)).cast(SIBLINGS)


def stored_levels(leaves: DataFrame, keys: list[str]) -> list[DataFrame]:
    """The written levels over ``leaves(keys, idx, n, node)``, from the leaves up to the subroots."""
    levels = [leaves.select(*keys, "idx", "n", "node")]
    widest = levels[0].agg(F.max("n")).first()[0] or 0
    while widest > 1:
        top = _subtrees(levels[-1], keys).select(
            *keys, F.col("g").alias("idx"), F.ceil(F.col("n") / SPAN).cast("long").alias("n"), F.element_at(f"l{STRIDE}", 1).alias("node")
        )
        levels.append(hand_over(top))
        widest = -(-widest // SPAN)
    return levels


def _same(a: str, b: str, keys: list[str]) -> Column:
    met = F.lit(True)
    for k in keys:
        met &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return met


def proofs(levels: list[DataFrame], rows: DataFrame, keys: list[str], tops: DataFrame, finish: dict[str, Column]) -> DataFrame:
    """``rows(keys, idx, n, node, …)``, the leaves, with the columns of ``finish`` made from ``proof``.

    ``tops(keys, proof)`` has the siblings from each subroot on, ``proof`` those from the leaf on.
    """
    carried = [c for c in rows.columns if c not in [*keys, "idx", "n", "node"]]
    # the subroots with their siblings, then level by level down
    above = levels[-1].alias("s").join(tops.alias("t"), _same("s", "t", keys)).select("s.*", "t.proof")
    for level in range(len(levels) - 2, -1, -1):
        last = level == 0
        trees = _subtrees(rows if last else levels[level], keys, *(carried if last else []))
        met = _same("d", "a", keys) & (F.col("d.g") == F.col("a.idx"))
        upper = above.select(*keys, "idx", "proof").alias("a")
        open_ = trees.alias("d").join(upper, met).select("d.*", F.col("a.proof").alias("_upper"))
        one = open_.select("*", F.posexplode("own").alias("_place", "_one")).withColumn("proof", F.concat(_siblings(F.col("_place")), "_upper"))
        if last:
            return one.select(*keys, "_one.*", "proof").select(*keys, "node", *carried, *[c.alias(n) for n, c in finish.items()])
        above = hand_over(one.select(*keys, "_one.*", "proof"))
    return _single(rows, above, keys, carried, finish)


def _single(rows: DataFrame, above: DataFrame, keys: list[str], carried: list[str], finish: dict[str, Column]) -> DataFrame:
    """Proofs where every key has one leaf only, which is its subroot."""
    met = _same("r", "a", keys)
    joined = rows.alias("r").join(above.select(*keys, "proof").alias("a"), met).select("r.*", "a.proof")
    return joined.select(*keys, "node", *carried, *[c.alias(n) for n, c in finish.items()])


def folded(start: Column) -> Column:
    """The root that a leaf leads to with the siblings in ``proof``."""
    return F.aggregate("proof", start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest() -> Column:
    return digest(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(leaves: DataFrame, key: str, finish: dict[str, Column], order: str = "doc_id") -> DataFrame:
    """``leaves(key, order, node, …)`` with ``subroot``, ``root`` and the columns of ``finish``, which may use ``proof``."""
    prepare(leaves.sparkSession)
    rows = hand_over(_numbered(leaves, [key], [F.col(order).asc_nulls_first(), F.col("node")]))
    levels = stored_levels(rows, [key])
    keyed = levels[-1].select(F.col("node").alias("subroot"), F.col(key)).withColumn("_all", F.lit(0))
    # the subroots are the leaves of one more tree
    top = hand_over(_numbered(keyed, ["_all"], [F.col(key).asc_nulls_first()]).withColumnRenamed("subroot", "node"))
    upper = stored_levels(top, ["_all"])
    root = upper[-1].select("_all", F.col("node").alias("root"))
    begin = root.select("_all", F.array().cast(SIBLINGS).alias("proof"))
    tops = hand_over(proofs(upper, top, ["_all"], begin, {"proof": F.col("proof")}).join(F.broadcast(root), "_all"))  # one row
    # the root and the subroot go down beside the proof, as an entry behind its last one
    ends = tops.withColumn("proof", F.concat("proof", F.array(F.struct(F.col("node").alias("left"), F.col("root").alias("right")))))
    end = F.element_at("proof", -1)
    found = proofs(levels, rows, [key], ends.select(key, "proof"), {"_end": end, "proof": F.slice("proof", F.lit(1), F.size("proof") - 1)})
    given = [c for c in leaves.columns if c != "node"]
    return found.select(*given, "node", F.col("_end.left").alias("subroot"), F.col("_end.right").alias("root"), *[c.alias(n) for n, c in finish.items()])


def tampered(doc_id: Column) -> Column:
    """Whether the check of the manifest alters a row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def audit(docs: DataFrame, columns: list[str] = COLUMNS, key: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: every row's proof, checked against altered rows.

    Rows whose id's checksum is divisible by three are altered: A-Z of their text in lower case.
    """
    other = F.translate(F.col(text), UPPER, UPPER.lower())
    changed = tampered(F.col(doc_id)) & F.coalesce(F.col(text).rlike("[A-Z]"), F.lit(False))
    altered = leaf([other if c == text else F.col(c) for c in columns])
    leaves = docs.select(
        F.col(key).alias("_key"), F.col(doc_id).alias("_id"), leaf([F.col(c) for c in columns]).alias("node"), F.when(changed, altered).alias("altered")
    )
    finish = {"proof_sha256": proof_digest(), "folded_root": folded(F.coalesce("altered", "node"))}
    found = manifest(leaves, "_key", finish, "_id")
    return found.select(
        F.col("_id").alias(doc_id),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op11(spark, folder: str) -> DataFrame:
    return audit(spark.read.parquet(f"{folder}/documents.parquet"))


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in COLUMNS) + ")"


OP11_SQL = f"""
WITH RECURSIVE sums AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS altered
  FROM sums
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, idx, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(node, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY lang, level, idx // {FAN}, n
), tops AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, idx, n, subroot AS node FROM tops
  UNION ALL
  SELECT level + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(node, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY level, idx // {FAN}, n
), beside AS (
  SELECT lang, level, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WINDOW w AS (PARTITION BY lang, level, idx // {FAN} ORDER BY idx)
), beside_upper AS (
  SELECT level, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper WINDOW w AS (PARTITION BY level, idx // {FAN} ORDER BY idx)
), folds AS (
  SELECT doc_id, leaf, lang, 0 AS level, idx, n, coalesce(altered, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, f.lang, f.level + 1, f.idx // {FAN}, (f.n + {FAN - 1}) // {FAN}, sha256(b.l || f.h || b.r), f.proof || b.l || b.r
  FROM folds f JOIN beside b ON f.lang IS NOT DISTINCT FROM b.lang AND f.level = b.level AND f.idx = b.idx WHERE f.n > 1
), rises AS (
  SELECT f.doc_id, f.leaf, t.subroot, 0 AS level, t.idx, t.n, f.h, f.proof
  FROM folds f JOIN tops t ON f.lang IS NOT DISTINCT FROM t.lang WHERE f.n = 1
  UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.idx // {FAN}, (f.n + {FAN - 1}) // {FAN}, sha256(b.l || f.h || b.r), f.proof || b.l || b.r
  FROM rises f JOIN beside_upper b ON f.level = b.level AND f.idx = b.idx WHERE f.n > 1
)
SELECT f.doc_id, f.leaf, f.subroot, u.node AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = u.node AS verified
FROM rises f, (SELECT node FROM upper WHERE n = 1) u WHERE f.n = 1
"""
