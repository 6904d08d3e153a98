"""Column functions over dynamic content: page text or JSON of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)^\s*```[a-zA-Z]*\s*(.*?)\s*```\s*$"


def json_kind(j: Column) -> Column:
    """object, list, string, null or scalar; SQL null for text that is no JSON."""
    first = F.substring(F.ltrim(j), 1, 1)
    return F.when(
        F.try_parse_json(j).isNotNull(),
        F.when(first == "{", "object")
        .when(first == "[", "list")
        .when(first == '"', "string")
        .when(first == "n", "null")
        .otherwise("scalar"),
    )


def compact_json(j: Column) -> Column:
    return F.to_json(F.try_parse_json(j))


def list_items(j: Column) -> Column:
    """``array<variant>`` of a JSON list, null for anything else."""
    return F.when(json_kind(j) == "list", F.try_variant_get(F.try_parse_json(j), "$", "array<variant>"))


def content_size(data: Column, kind: Column) -> Column:
    """Characters of a page, or of the compact serialisation of JSON; 0 if absent."""
    size = F.when(kind == "html", F.length(data)).otherwise(
        F.coalesce(F.length(compact_json(data)), F.length(data))
    )
    return F.coalesce(size, F.lit(0))


def fast_path_size(data: Column, kind: Column) -> Column:
    """Size estimate of a vendor answer: 1000 per list item."""
    size = (
        F.when(kind == "html", F.length(data))
        .when(json_kind(data) == "list", F.json_array_length(data) * 1000)
        .otherwise(F.coalesce(F.length(compact_json(data)), F.length(data)))
    )
    return F.coalesce(size, F.lit(0))


def fast_path_usable(success: Column, data: Column, kind: Column, min_size: int) -> Column:
    """One answer is good enough: a long page, or any non-empty list or object."""
    found = json_kind(data)
    usable = (
        F.when(kind == "html", F.length(data) >= min_size)
        .when(found == "list", F.json_array_length(data) > 0)
        .when(found == "object", F.size(F.json_object_keys(data)) > 0)
        .when(found == "null", F.lit(False))
        .otherwise(F.length(data) > 0)
    )
    return F.coalesce(success & usable, F.lit(False))


def strip_fence(text: Column) -> Column:
    """Remove a surrounding code fence, if there is one."""
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def _as_text(v: Column) -> Column:
    """Plain text of a variant: strings bare, lists and objects as JSON."""
    shape = F.schema_of_variant(v)
    nested = shape.startswith("OBJECT") | shape.startswith("ARRAY")
    return F.when(nested, F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def _object_map(v: Column) -> Column:
    return F.transform_values(
        F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: _as_text(x)
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _merge_last_wins(maps: Column) -> Column:
    """All entries sorted by key, later objects first; the first of each key stays."""

    def entries(m: Column, i: Column) -> Column:
        return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), (-i).alias("nr"), e["value"].alias("value")))

    def first_of_each(found: Column) -> Column:
        kept = F.filter(found, lambda e, k: (k == 0) | (F.get(found, k - 1)["key"] != e["key"]))
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    return _let(F.array_sort(F.flatten(F.transform(maps, entries))), first_of_each)


def _normalise_list(items: Column) -> Column:
    shapes = F.transform(items, lambda x: F.schema_of_variant(x))
    all_objects = F.forall(shapes, lambda s: F.coalesce(s.startswith("OBJECT"), F.lit(False)))
    numbered = F.map_from_entries(
        F.transform(
            items,
            lambda x, i: F.struct(F.concat(F.lit("item_"), i.cast("string")).alias("key"), _as_text(x).alias("value")),
        )
    )
    return F.when(all_objects, _merge_last_wins(F.transform(items, _object_map))).otherwise(numbered)


def normalise(j: Column) -> Column:
    """Any JSON content as one ``map<string,string>``.

    Objects stay, lists of objects are merged with the last value winning, an
    empty list gives an empty map, other lists become ``item_0 …``, scalars
    ``{"value": x}``; JSON null, SQL null and text that is no JSON give null.
    """
    first = F.substring(F.ltrim(j), 1, 1)

    def by_kind(v):
        items = F.try_variant_get(v, "$", "array<variant>")
        return (
            F.when(v.isNull() | (first == "n"), F.lit(None))
            .when(first == "{", _object_map(v))
            .when(first == "[", _let(items, _normalise_list))
            .otherwise(F.create_map(F.lit("value"), _as_text(v)))
        )

    return _let(F.try_parse_json(j), by_kind)


def row_count(j: Column) -> Column:
    """Rows of a vendor answer: items of a list, 1 for an object."""
    kind = json_kind(j)
    return F.when(kind == "list", F.json_array_length(j)).when(kind == "object", 1).otherwise(0)


def field_count(j: Column) -> Column:
    """Keys of an object, or of the first object of a list."""
    kind = json_kind(j)
    first = F.get(list_items(j), F.lit(0))
    first_keys = F.map_keys(F.try_variant_get(first, "$", "map<string,variant>"))
    return (
        F.when(kind == "object", F.size(F.json_object_keys(j)))
        .when(kind == "list", F.coalesce(F.size(first_keys), F.lit(0)))
        .otherwise(0)
    )
