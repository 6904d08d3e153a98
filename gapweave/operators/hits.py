"""Ranked links of several search channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEARCH_CACHE_SECONDS
from ..functions import urls
from . import running


def _check_k(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def top_k(rows: DataFrame, keys: list[str], order: list, k: int, out: str = "pos") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= _check_k(k))


def interleave(hits: DataFrame) -> DataFrame:
    """Round-robin position over the channels: all first hits, all second hits …"""
    return running.row_numbers(
        hits, ["entity_id"], ["channel_rank", "channel_order"], "pos"
    )


def first_per_link(hits: DataFrame, pos: str = "pos") -> DataFrame:
    """Keep each link's earliest row.

    A grouped minimum instead of a window: duplicates are dropped before the
    shuffle, and no link's copies have to meet in one sorted group.
    """
    rest = [c for c in hits.columns if c not in ("entity_id", "link")]
    earliest = F.min_by(F.struct(*rest), F.col(pos))
    return hits.groupBy("entity_id", "link").agg(earliest.alias("h")).select("entity_id", "link", "h.*")


def usable_links(hits: DataFrame) -> DataFrame:
    link = F.col("link")
    return hits.filter(urls.is_valid_url(link) & ~urls.is_file_link(link))


def select_links(hits: DataFrame, k: int, interleaved: bool = True, deduplicate: bool = True) -> DataFrame:
    """Links to fetch for each entity, in order.

    All hits are validated, mixed and deduplicated; only then are they cut to
    ``k``, so a channel that opens with unusable links still gives its good ones.
    """
    _check_k(k)
    order = ["channel_rank", "channel_order"] if interleaved else ["channel_order", "channel_rank"]
    hits = usable_links(hits).withColumn("_o", F.struct(*order, "link"))
    if deduplicate:
        hits = first_per_link(hits, "_o")
    return top_k(hits, ["entity_id"], ["_o"], k).drop("_o")


def trim_channels(hits: DataFrame, k: int) -> DataFrame:
    """Each channel's own list cut to ``k``."""
    return top_k(hits, ["entity_id", "channel"], ["channel_rank", "link"], k)


def first_links(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` links of the whole list."""
    return hits.orderBy("channel_rank", "channel_order", "entity_id").limit(n)


def uncached_requests(requests: DataFrame, cache: DataFrame, seconds: int = SEARCH_CACHE_SECONDS) -> DataFrame:
    """Requests with no answer cached during the last ``seconds``.

    Requests and answers are put in one time order per query, and each request
    looks back at the latest answer before it: work grows with their number, not
    with the pairs of requests and answers of a popular query.
    """
    keys = ["query", "top_k"]
    asked = requests.withColumn("_cached", F.lit(None).cast("timestamp")).withColumn("_at", F.col("ts").cast("timestamp"))
    known = cache.select(*keys, F.col("cached_at").cast("timestamp").alias("_cached"), F.col("cached_at").cast("timestamp").alias("_at"))
    both = asked.withColumn("_is_request", F.lit(True)).unionByName(
        known.withColumn("_is_request", F.lit(False)), allowMissingColumns=True
    )
    # at the same instant the answer comes first
    done = running.running_max(both, keys, ["_at", "_is_request"], "_cached", "_latest")
    age = F.unix_micros("_at") - F.unix_micros("_latest")
    fresh = F.coalesce(age <= seconds * 1_000_000, F.lit(False))
    return done.filter(F.col("_is_request") & ~fresh).select(*requests.columns)
