"""Wanted fields and their keywords as a table of any length.

Field lists in the configuration become one ``contains`` each, which is best for a
handful.  A table of thousands of keywords becomes an automaton instead: it reads a
block once, from left to right, and is at every place in the state of the longest
beginning of a keyword that ends there, so all keywords are found in one pass whatever
their number.  The table is sent to the tasks in parts of a bounded size, each part a
pass of its own, and no block is shuffled for it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..session import hand_over

# Bytes of keywords and field names in one automaton; a worker takes some ten times as much for it.
PART_BYTES = 8 << 20

def wanted_keywords(table: DataFrame, field: str = "field", keyword: str = "keyword") -> DataFrame:
    """``field, keyword``: distinct, in lower case, without blank keywords or unnamed fields."""
    rows = table.select(F.col(field).cast("string").alias("field"), F.lower(urls.strip(keyword)).alias("keyword"))
    return rows.filter("field IS NOT NULL AND keyword != ''").distinct()


# The automata of a worker, by the part they were made from.
_MADE: dict[str, object] = {}


def _automaton(token: str, sent):
    """One automaton for each worker and part; the last few are kept."""
    import ahocorasick

    if token not in _MADE:
        fields = defaultdict(list)
        for field, keyword in sent.value:
            fields[keyword].append(field)
        automaton = ahocorasick.Automaton()
        for keyword, names in fields.items():
            automaton.add_word(keyword, names)
        automaton.make_automaton()
        while len(_MADE) >= 2:
            _MADE.pop(next(iter(_MADE)))
        _MADE[token] = automaton
    return _MADE[token]


def _finder(sent):
    """A column function: the fields that have a keyword in a lower-case text, in order of their names."""
    token = uuid.uuid4().hex

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def fields(texts: pa.Array) -> pa.Array:
        automaton, out = _automaton(token, sent), []
        for text in texts.to_pylist():
            found = set()
            if text and len(automaton):
                for _, names in automaton.iter(text):
                    found.update(names)
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.string()))

    return fields


def fields_in_blocks(blocks: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("url", "pos"), block: str = "block") -> DataFrame:
    """``keys, field``: each block with the fields whose keywords it contains, once each."""
    spark = blocks.sparkSession
    table = hand_over(wanted_keywords(wanted))
    size = table.agg(F.sum(F.octet_length("field") + F.octet_length("keyword"))).first()[0] or 0
    parts = max(-(-size // PART_BYTES), 1)
    listed = table.withColumn("part", F.pmod(F.xxhash64("keyword"), F.lit(parts)))
    found = []
    for part in range(parts):  # each about PART_BYTES, bounded
        rows = [tuple(r) for r in listed.filter(F.col("part") == part).select("field", "keyword").collect()]
        names = _finder(spark.sparkContext.broadcast(rows))(F.lower(block))
        found.append(blocks.select(*keys, F.explode(names).alias("field")))
    if parts == 1:
        return found[0]
    # a field may have keywords in several parts
    rest = found[0]
    for more in found[1:]:
        rest = rest.unionByName(more)
    return rest.distinct()
