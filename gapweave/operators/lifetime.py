"""Requests that are let through once in a lifetime, over a whole table of any span.

The first request of a key is let through, then the first one more than a lifetime
after the one let through last, and so on.  That is a chain in each key, which looks
serial; here it is followed in steps that double.  Every instant gets its successor,
the first instant more than a lifetime later, by one pass in order of time.  Then the
instants reached from the first one within 1, 2, 4, 8 … steps are joined with jumps of
that many steps.  A chain of n links takes log2(n) rounds, rows are dealt out by key and
instant, and no task holds a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import hand_over
from . import running


def successors(nodes: DataFrame, keys: list[str], at: str, lifetime: int) -> DataFrame:
    """``keys, at, next``: the first instant of the key more than ``lifetime`` after each one, null if there is none."""
    # from the latest to the earliest, probes before the instants they must not see
    stands = nodes.select(*keys, (-F.col(at)).alias("_back"), F.lit(1).alias("_kind"), (-F.col(at)).alias("_seen"), F.lit(None).cast("long").alias(at))
    probes = nodes.select(*keys, (-F.col(at) - lifetime).alias("_back"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_seen"), at)
    done = running.running_max(stands.unionByName(probes), keys, ["_back", "_kind"], "_seen", "_next")
    return done.filter("_kind = 0").select(*keys, at, (-F.col("_next")).alias("next"))


def _step(rows: DataFrame, jumps: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``rows`` moved on from ``at`` by the jumps that begin there."""
    j = jumps.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_at"), F.col("next").alias("_next"))
    met = F.col(at) == F.col("_at")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(j, met).withColumn(at, F.col("_next")).drop("_at", "_next", *[f"_{k}" for k in keys])


def chain(nodes: DataFrame, keys: list[str], at: str, lifetime: int) -> DataFrame:
    """``keys, at`` of the instants on the chain of each key that begins at its first one."""
    nodes = hand_over(nodes.select(*keys, F.col(at).cast("long").alias("at")).filter("at IS NOT NULL").distinct())
    jumps = hand_over(successors(nodes, keys, "at", lifetime).filter("next IS NOT NULL"))
    reached = hand_over(nodes.groupBy(*keys).agg(F.min("at").alias("at")))
    # a chain only runs over firsts and successors, which are far fewer where requests are dense
    stops = hand_over(jumps.select(*keys, F.col("next").alias("at")).unionByName(reached).distinct())
    stop = stops.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_at"))
    met = F.col("at") == F.col("_at")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    jumps = hand_over(jumps.join(stop, met, "left_semi"))
    while True:
        further = hand_over(_step(reached, jumps, keys, "at"))
        if further.isEmpty():
            return reached
        reached = hand_over(reached.unionByName(further))
        jumps = hand_over(_step(jumps, jumps, keys, "next"))


def first_requests(requests: DataFrame, keys: list[str], ts: str, unique: str, seconds: int = 3600) -> DataFrame:
    """The requests let through, one per key and instant of its chain; ties go to the smaller ``unique``.

    Requests without an instant are not let through.  A null key is a key of its own.
    """
    timed = requests.withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp")))
    through = chain(timed, keys, "_micros", seconds * 1_000_000)
    chosen = through.select(*[F.col(k).alias(f"_{k}") for k in keys], "at")
    met = F.col("_micros") == F.col("at")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    # many requests of one instant: a partial minimum, not a group in one task
    row = F.struct(*[c for c in requests.columns if c not in keys])
    met_rows = timed.join(chosen, met).groupBy(*keys, "at").agg(F.min_by(row, F.col(unique)).alias("_row"))
    return met_rows.select(*keys, "_row.*").select(*requests.columns)
