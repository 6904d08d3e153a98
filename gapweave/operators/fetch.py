"""Requested links against the store of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VENDOR_SEARCH_URLS
from ..functions import content, html, urls
from . import running

KEY = ["entity_id", "url"]
NO_PAGE = "No page was fetched"
NO_EXTRACT = "Extraction returned nothing"


# --- predicates ---------------------------------------------------------------


def is_extractable() -> Column:
    return (F.col("status") == "ready") & (F.length("data") > 0)


def ready(scrapes: DataFrame) -> DataFrame:
    return scrapes.filter(F.col("status") == "ready")


def extractable(scrapes: DataFrame) -> DataFrame:
    """Ready pages that hold any data: what extraction works on."""
    return scrapes.filter(is_extractable())


def size_gate(scrapes: DataFrame, min_chars: int) -> DataFrame:
    """Mark pages below the minimum size, which are most likely error pages."""
    size = F.length("data")
    message = F.format_string(
        "Scrape for %s... too small: %d chars", F.substring("url", 1, 40), size
    )
    return (
        scrapes.withColumn("n_chars", size)
        .withColumn("passed", size >= min_chars)
        .withColumn("gate_error", F.when(size < min_chars, message))
    )


def trim_long(scrapes: DataFrame, limit: int | None, body: str = "data") -> DataFrame:
    """Cut bodies at ``limit`` characters and record where that happened; ``None`` cuts nothing."""
    if limit is None:
        return scrapes.withColumn("trimmed_to", F.lit(None).cast("int"))
    return scrapes.withColumn("trimmed_to", F.when(F.length(body) > limit, F.lit(limit))).withColumn(
        body, F.substring(body, 1, limit)
    )


def reduce_long(scrapes: DataFrame, above: int, body: str = "data") -> DataFrame:
    """Reduce only bodies for which it pays off."""
    long = F.length(body) > above
    return scrapes.withColumn("reduced", F.coalesce(long, F.lit(False))).withColumn(
        body, F.when(long, html.reduce_html(F.col(body))).otherwise(F.col(body))
    )


def scrape_summary(scrapes: DataFrame) -> DataFrame:
    """What a log keeps of a fetched page: sizes and kinds, no body."""
    return scrapes.select(
        *KEY,
        "success",
        "status",
        "cost",
        "error",
        "fallback_used",
        urls.host(F.col("url")).alias("root_domain"),
        F.when(F.col("data").isNull(), "none").otherwise(F.col("data_kind")).alias("data_type"),
        F.coalesce(F.length("data"), F.lit(0)).alias("data_size"),
    )


# --- fast path ----------------------------------------------------------------


def fast_path_requests(entities: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """One vendor search link per entity and domain, as an array to explode."""
    links = F.array(
        *[
            F.struct(
                F.lit(d).alias("domain"),
                F.concat(F.lit(VENDOR_SEARCH_URLS[d]), "name").alias("url"),
            )
            for d in domains
        ]
    )
    return entities.select("*", F.explode(links).alias("link")).select("*", "link.*").drop("link")


def judged_answers(answers: DataFrame, min_size: int) -> DataFrame:
    """What the outcome needs of each answer, judged in its own row; no body goes on."""
    usable = content.fast_path_usable(F.col("success"), F.col("data"), F.col("data_kind"), min_size)
    any_data = F.col("success") & (F.length("data") > 0)
    kept = [c for c in answers.columns if c in KEY]
    return answers.select(*kept, usable.alias("usable"), any_data.alias("any_data"))


def fast_path_outcome(results: DataFrame, min_size: int) -> DataFrame:
    """Per entity: did any vendor answer suffice?"""
    return outcome_of(judged_answers(results, min_size))


def outcome_of(judged: DataFrame) -> DataFrame:
    """As ``fast_path_outcome``, of answers that are judged already."""
    return judged.groupBy("entity_id").agg(
        F.bool_or("usable").alias("usable"),
        F.bool_or("any_data").alias("any_data"),
        F.count("*").alias("n_results"),
    )


def route(entities: DataFrame, outcome: DataFrame, always_continue: bool = False):
    """``(served, remaining)``: entities the fast path answered and the others."""
    good = outcome.filter("usable").select("entity_id")
    served = entities.join(good, "entity_id", "left_semi")
    remaining = entities if always_continue else entities.join(good, "entity_id", "left_anti")
    return served, remaining


# --- joins --------------------------------------------------------------------


def fetch(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Each requested link gets its page; missing pages become failed rows.

    Both sides are hashed by link; a link many entities ask for is split by the
    skew handling of the join, since only the request side repeats it.
    """
    store = pages.select(
        "url", F.col("html").alias("data"), F.lit(True).alias("found"), *[c for c in pages.columns if c == "cost"]
    )
    if "cost" not in store.columns:
        store = store.withColumn("cost", F.lit(0.0))
    found = F.coalesce("found", F.lit(False))
    return (
        requests.join(store, "url", "left")
        .withColumn("success", found)
        .withColumn("status", F.when(found, "ready").otherwise("failed"))
        .withColumn("cost", F.coalesce("cost", F.lit(0.0)))
        .withColumn("error", F.when(~found, F.lit(NO_PAGE)))
        .withColumn("data_kind", F.lit("html"))
        .drop("found")
    )


def retry_set(scrapes: DataFrame) -> DataFrame:
    """Links with no ready row."""
    done = ready(scrapes).select(*KEY)
    return scrapes.select(*KEY).distinct().join(done, KEY, "left_anti")


def merge_attempts(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per link: the second attempt wins only where the first failed
    and the second is ready; links only the second knows are kept.

    Ready rows of the first attempt never change, so their bodies are passed
    on without being shuffled; only the keys take part.
    """
    columns = first.columns
    done = ready(first)
    open_rows = first.filter(~F.coalesce(F.col("status") == "ready", F.lit(False)))
    useful = second.select(*columns).join(done.select(*KEY), KEY, "left_anti")
    both = open_rows.select(*KEY, F.struct(*columns).alias("a")).join(
        useful.select(*KEY, F.struct(*columns).alias("b")), KEY, "full_outer"
    )
    take_second = F.col("a").isNull() | F.coalesce(F.col("b.status") == "ready", F.lit(False))
    chosen = both.select(F.when(take_second, F.col("b")).otherwise(F.col("a")).alias("r")).select("r.*")
    return done.unionByName(chosen)


def update_rows(earlier: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """Map update: a later row replaces the earlier one under the same key."""
    return earlier.join(later.select(*keys), keys, "left_anti").unionByName(later)


def both_paths(normal: DataFrame, fast: DataFrame) -> DataFrame:
    return normal.withColumn("path", F.lit("normal")).unionByName(
        fast.withColumn("path", F.lit("fast")), allowMissingColumns=True
    )


def with_failed_rows(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Every asked link gets a row, a failed one where no answer came back."""
    return (
        asked.join(answers, KEY, "left")
        .withColumn("error", F.when(F.col("success").isNull(), F.lit(NO_EXTRACT)).otherwise(F.col("error")))
        .withColumn("success", F.coalesce("success", F.lit(False)))
    )


# --- reasons ------------------------------------------------------------------


def failure_reason() -> Column:
    """Why a link brought nothing; null if it brought something."""
    where = F.concat(F.substring("url", 1, 50), F.lit("...: "))
    # an empty list or object is data that was returned, but holds nothing
    empty = content.json_kind(F.col("data")).isin("list", "object") & (
        F.regexp_replace("data", r"\s+", "").isin("[]", "{}")
    )
    return (
        F.when(~F.col("success"), F.concat(where, F.coalesce("error", F.lit("Unknown error"))))
        .when(F.coalesce(F.length("data"), F.lit(0)) == 0, F.concat(where, F.lit("No data returned")))
        .when((F.col("data_kind") != "html") & empty, F.concat(where, F.lit("Empty data")))
    )


def failure_reasons(scrapes: DataFrame) -> DataFrame:
    """One reason per link that brought nothing."""
    return scrapes.select(*KEY, failure_reason().alias("reason")).filter(F.col("reason").isNotNull())


def numbered_texts(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Texts of a key in order, one row each: ``keys, nr, text`` with nr = 1, 2, 3 …

    Rows and not one joined text, so that a key may have any number of them.
    """
    listed = rows.select(*keys, F.col(order).alias("_order"), F.col(text).alias("text"))
    return running.row_numbers(listed, keys, ["_order", "text"], "nr").select(*keys, "nr", "text")
