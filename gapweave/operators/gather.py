"""Values of many pages fused into one per entity and field, then filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["entity_id", "field"]


def confident_values(values: DataFrame, threshold: float, relaxed: float, minimum: int) -> DataFrame:
    """Keep values at or above the threshold; an entity with fewer than
    ``minimum`` of them is judged by the relaxed one."""
    value = F.col("confidence") >= threshold
    per_entity = values.groupBy("entity_id").agg(F.count_if(value).alias("_n_ok"))
    limit = F.when(F.col("_n_ok") >= minimum, F.lit(threshold)).otherwise(F.lit(relaxed))
    return values.join(per_entity, "entity_id").filter(F.col("confidence") >= limit).drop("_n_ok")


def votes(values: DataFrame) -> DataFrame:
    """How often each value was found, and its best source."""
    best = F.min_by("url", F.struct(-F.coalesce("confidence", F.lit(-1.0)), F.col("url")))
    return (
        values.filter(F.col("value").isNotNull())
        .groupBy(*KEY, "value")
        .agg(F.count("*").alias("votes"), F.max("confidence").alias("confidence"), best.alias("source_url"))
    )


def fuse(values: DataFrame) -> DataFrame:
    """One value per entity and field: highest confidence, then most votes,
    then the greatest text."""
    order = F.struct("confidence", "votes", "value")
    chosen = F.max_by(F.struct("value", "confidence", "votes", "source_url"), order)
    return votes(values).groupBy(*KEY).agg(chosen.alias("v")).select(*KEY, "v.*")


def agreement(values: DataFrame) -> DataFrame:
    """Distinct values of each field and the share of the most frequent one."""
    per_value = votes(values)
    top = F.max_by("value", F.struct("votes", "value"))
    return per_value.groupBy(*KEY).agg(
        F.count("*").alias("distinct_values"),
        F.sum("votes").alias("n_values"),
        top.alias("top_value"),
        F.round(F.max("votes") / F.sum("votes"), 6).alias("agreement"),
    )


def approximate_agreement(values: DataFrame) -> DataFrame:
    """The number of distinct values from a sketch, where exact counts cost too much."""
    known = values.filter(F.col("value").isNotNull())
    return known.groupBy(*KEY).agg(F.approx_count_distinct("value", 0.02).alias("distinct_values"))


# Sketches have 2 ** SKETCH_BITS registers; an estimate is off by SKETCH_ERROR three times out of a thousand.
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def value_sketches(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys, sketch``: the distinct values of each key as a sketch of a few kB, to be stored and united later.

    Values of a key are added to sketches before the shuffle, so a frequent key sends one from each task.
    """
    known = values.filter(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value).cast("string"), SKETCH_BITS).alias("sketch"))


def united_counts(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_sketches, distinct_values``: distinct values over all sketches of a key, a value of several counted once."""
    return sketches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sketches"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values")
    )


def impute(target: DataFrame, fused: DataFrame, fields: list[str]) -> DataFrame:
    """Fill missing cells of ``target`` and tell where each value came from.

    The fused values become one row per entity, so every target row joins once.
    """
    wide = fused.groupBy("entity_id").agg(
        *[
            F.max(F.when(F.col("field") == f, F.struct("value", "source_url", "confidence"))).alias(f"_{f}")
            for f in fields
        ]
    )
    joined = target.join(wide, "entity_id", "left")
    filled = [F.coalesce(f, F.col(f"_{f}.value")).alias(f) for f in fields]
    sources = [F.when(F.col(f).isNull(), F.col(f"_{f}.source_url")).alias(f"{f}_source") for f in fields]
    kept = [c for c in target.columns if c not in fields]
    return joined.select(*kept, *filled, *sources)
