"""Ranked search of a corpus for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..session import hand_over
from . import hits

PLACES = 6
WORD_BREAK = r"[^\p{L}\p{N}]+"
NO_RESULTS = "no results"
# Words of all queries together that may be broadcast (about 100 bytes each).
MAX_BROADCAST_WORDS = 1_000_000
# Postings times the queries that have their word, for one task; it holds a pair for each at most (up to 1 kB).
TASK_MEETINGS = 1_000_000
# Postings times the queries that have their word, beyond which only candidates are scored: pairs grow with queries times documents.
MOST_MEETINGS = 30_000_000
# Words of the queries whose candidates are looked for at once; each has a few limits.
PART_WORDS = 400_000
SEED_WORDS = 3
SLACK = 1e-4
# Joins take a partitioning by some of their keys, as by document.
BY_SOME_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
QUERY = ["entity_id", "channel"]
PAIR = ["entity_id", "channel", "doc_id"]


def words(text):
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def page_corpus(pages: DataFrame) -> DataFrame:
    """Title and body of each page as two search channels, from one scan."""
    rows = pages.select(
        F.col("page_id").alias("doc_id"),
        html.page_title(F.col("html")).alias("title"),
        html.html_to_text(F.col("html")).alias("body"),
    )
    channels = F.array(
        F.struct(F.lit("title").alias("channel"), F.col("title").alias("text")),
        F.struct(F.lit("body").alias("channel"), F.col("body").alias("text")),
    )
    return rows.select("doc_id", F.inline(channels))


def page_names(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").alias("doc_id"), F.col("url").alias("link"), html.page_title(F.col("html")).alias("title")
    )


def _broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if a count shows it is small enough, else leave it alone."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_WORDS else df


def postings(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(asked, postings)``: the words of each query, and how often each of them
    occurs in each document.

    The corpus is read and cut into words once.  Only occurrences of query words
    go on, counted per document before they are shuffled, and the counts are
    written for the steps that follow.
    """
    asked = queries.select("entity_id", F.explode(F.array_distinct(words(F.col("name")))).alias("word"))
    n_asked = asked.limit(MAX_BROADCAST_WORDS + 1).count()
    wanted = asked.select("word").distinct()
    found = (
        # the empty word between two breaks is no query word and is dropped by the join
        corpus.select("channel", "doc_id", F.explode(F.split(F.lower("text"), WORD_BREAK)).alias("word"))
        .join(_broadcast_if_small(wanted, n_asked), "word", "left_semi")
        .groupBy("channel", "doc_id", "word")
        .agg(F.count("*").alias("tf"))
    )
    return asked, hand_over(found)


def once_per_query(queries: DataFrame, searched: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``searched(queries)`` finds, asked once for each set of words; all queries of these words get it."""
    given = queries.select("entity_id", F.array_sort(F.array_distinct(words(F.col("name")))).alias("_words"))
    asked = given.filter(F.size("_words") > 0)
    once = hand_over(asked.select("_words").distinct().withColumn("_query", F.monotonically_increasing_id()))
    found = searched(once.select(F.col("_query").alias("entity_id"), F.array_join("_words", " ").alias("name")))
    # answers are a few rows a query; their number, and not that of the queries, is what meets
    members = asked.join(once, "_words").select("entity_id", "_query")
    return members.join(found.withColumnRenamed("entity_id", "_query"), "_query").drop("_query")


def search(queries: DataFrame, corpus: DataFrame, n_docs: int, k: int) -> DataFrame:
    """The ``k`` best documents of each channel for every query."""
    return once_per_query(queries, lambda once: _search(once, corpus, n_docs, k))


def _search(queries: DataFrame, corpus: DataFrame, n_docs: int, k: int) -> DataFrame:
    """As ``search``, for queries that differ in their words.

    The score is the sum of tf·idf over the query's distinct words.  The postings are
    dealt out by document once and scored where they are, so no pair of query and
    document reaches a shuffle unless it can still be among the first ``k``.
    """
    asked, found = postings(queries, corpus)
    idf = F.log((F.lit(n_docs) + 1) / (F.col("df") + 1))
    weights = found.groupBy("channel", "word").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
    terms = hand_over(asked.join(weights.withColumn("idf", idf), "word"))
    zero = F.lit(0)
    size = terms.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("df"), zero).alias("all"), F.coalesce(F.sum(F.least("df", F.lit(k))), zero).alias("leading")
    ).first()
    if size.n <= MAX_BROADCAST_WORDS and size["all"] <= MOST_MEETINGS:
        scores = _scores_in_place(found, terms, size["all"], size.leading, k)
    else:
        # so many queries at once that their words and limits may be broadcast
        parts = max(1, -(-size.n // PART_WORDS))
        part_of = F.pmod(F.xxhash64("entity_id"), F.lit(parts))
        each = [_scores_of_likely(found, terms.filter(part_of == i), -(-size.leading // parts), k) for i in range(parts)]
        scores = reduce(DataFrame.unionByName, each)
    return hits.top_k(scores, QUERY, [F.desc("score"), "doc_id"], k, "channel_rank")


def _leaders(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` documents of each word that hold it most often."""
    return hits.top_k(found, ["channel", "word"], [F.desc("tf"), "doc_id"], k, "_r").drop("_r")


def _tasks(meetings: int) -> int:
    return max(1, -(-meetings // TASK_MEETINGS))


def _scores_in_place(found: DataFrame, terms: DataFrame, meetings: int, leading: int, k: int) -> DataFrame:
    """Whole scores of all pairs that may be among the ``k`` best, without a shuffle of pairs.

    ``meetings`` of a posting and a query, and those of the leaders, set the number of tasks,
    so that none of them holds many pairs at once: a few postings may meet many queries.  What the leaders of a query's words have of these words is
    part of their scores, so the k-th of these sums is a bound that the answer reaches.
    """
    words_of = F.broadcast(terms.select(*QUERY, "word", "idf"))
    reached = _reached(_best_of_leaders(found, words_of, leading, k), k)
    least = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = found.repartition(max(least, _tasks(meetings)), "doc_id")
    scores = placed.join(words_of, ["channel", "word"]).groupBy(*PAIR).agg(_score())
    # a little below the bound, so that rounding cannot lose a pair that reaches it
    enough = F.coalesce(F.col("score") >= F.col("bound") - SLACK, F.lit(True))
    return scores.join(F.broadcast(reached), QUERY, "left").filter(enough).drop("bound")


def _best_of_leaders(found: DataFrame, words_of: DataFrame, leading: int, k: int) -> DataFrame:
    """The ``k`` best pairs of each query by what leaders of its words have of these words."""
    first = _leaders(found, k).repartition(_tasks(leading), "doc_id")
    seen = first.join(words_of, ["channel", "word"]).groupBy(*PAIR).agg(_score())
    return hits.top_k(seen, QUERY, [F.desc("score"), "doc_id"], k, "_r")


def _reached(best: DataFrame, k: int) -> DataFrame:
    """The least score of the ``k`` pairs of each query that has so many."""
    return best.groupBy(*QUERY).agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))


def _power(n):
    return F.floor(F.log2(n)).cast("int")


def _scores_of_likely(found: DataFrame, terms: DataFrame, leading: int, k: int) -> DataFrame:
    """Whole scores of all pairs that may be among the ``k`` best; the others are not scored.

    The best pairs of the leaders are scored whole, so that their k-th score is a better bound.  A document that holds each
    word of the query less often than that word's maximum times (bound / sum of the words' greatest contributions) stays
    below it.  Postings meet the limits of their word and power of two, and not all queries that have the word.  They lie by
    document, and so do the pairs they give and the words that are looked up for these; none of them is shuffled.
    """
    spark = found.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words_of = F.broadcast(terms.select(*QUERY, "word", "idf"))
    before = spark.conf.get(BY_SOME_KEYS, "true")
    spark.conf.set(BY_SOME_KEYS, "false")
    try:

        def scores_of(pairs: DataFrame, placed: DataFrame) -> DataFrame:
            lookups = pairs.join(words_of, QUERY)
            return lookups.join(placed.hint("shuffle_hash"), ["channel", "doc_id", "word"]).groupBy(*PAIR).agg(_score())

        best = hand_over(_best_of_leaders(found, words_of, leading, k).select(*PAIR))
        leaders = scores_of(best.repartition(least, "doc_id"), found.repartition(least, "doc_id"))
        reached = hand_over(_reached(leaders, k))
        most = terms.groupBy(*QUERY).agg(F.sum(F.col("idf") * F.col("max_tf")).alias("most"))
        # a little below the bound, so that rounding cannot let an excluded pair tie
        share = F.greatest(F.coalesce(F.try_divide(F.col("bound") - SLACK, F.col("most")), F.lit(0.0)), F.lit(0.0))
        # counts are whole numbers
        limit = F.greatest(F.ceil(share * F.col("max_tf") - SLACK), F.lit(1))
        rated = terms.join(most, QUERY).join(reached, QUERY, "left").select(*QUERY, "word", "max_tf", limit.alias("least"))
        levels = F.sequence(_power(F.col("least")), _power(F.col("max_tf")))
        limits = hand_over(rated.filter("least <= max_tf").select(*QUERY, "word", "least", F.explode(levels).alias("level")))
        level = ["channel", "word", "level"]
        levelled = found.withColumn("level", _power(F.col("tf")))
        asked = limits.groupBy(*level).agg(F.count("*").alias("queries"))
        met = levelled.groupBy(*level).agg(F.count("*").alias("postings")).join(asked, level)
        meetings = met.agg(F.coalesce(F.sum(F.col("queries") * F.col("postings")), F.lit(0)).alias("n")).first().n
        tasks = max(least, _tasks(meetings))
        known = levelled.repartition(tasks, "doc_id").join(_broadcast_if_small(limits, limits.count()), level)
        pairs = known.filter(F.col("tf") >= F.col("least")).select(*PAIR).distinct()
        scores = scores_of(pairs, found.repartition(tasks, "doc_id")).join(F.broadcast(reached), QUERY, "left")
        enough = F.coalesce(F.col("score") >= F.col("bound") - SLACK, F.lit(True))
        # written here, as the session plans by some of the keys for these steps only
        return hand_over(scores.filter(enough).drop("bound"))
    finally:
        spark.conf.set(BY_SOME_KEYS, before)


def _score():
    return F.round(F.sum(F.col("tf") * F.col("idf")), PLACES).alias("score")


def _scores_of(pairs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """Whole scores of given pairs, by looking up each word of the query."""
    lookups = pairs.join(terms.select(*QUERY, "word", "idf"), QUERY).repartition("doc_id")
    return lookups.join(found, ["channel", "doc_id", "word"]).groupBy(*PAIR).agg(_score())


def _candidates(found: DataFrame, terms: DataFrame, n_terms: int, k: int) -> DataFrame:
    """Pairs that may be among the ``k`` best; all others provably are not.

    Documents that lead in a query's weightiest words are scored first; their
    k-th score is a bound the answer reaches.  A document that holds each word of
    the query less often than that word's maximum times (bound / sum of the
    words' greatest contributions) stays below the bound, so frequent words only
    bring in the documents that use them most.
    """
    greatest = F.col("idf") * F.col("max_tf")
    weighty = hits.top_k(terms, QUERY, [F.desc(greatest), "word"], SEED_WORDS, "_r").select(*QUERY, "word")
    leaders = _leaders(found, k).select("channel", "word", "doc_id")
    seeds = _scores_of(weighty.join(leaders, ["channel", "word"]).select(*PAIR).distinct(), found, terms)
    best = hits.top_k(seeds, QUERY, [F.desc("score"), "doc_id"], k, "_r")
    reached = best.groupBy(*QUERY).agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    most = terms.groupBy(*QUERY).agg(F.sum(greatest).alias("most"))
    # a little below the bound, so that rounding cannot let an excluded pair tie
    share = F.greatest(F.coalesce(F.try_divide(F.col("bound") - SLACK, F.col("most")), F.lit(0.0)), F.lit(0.0))
    limits = (
        terms.join(most, QUERY)
        .join(reached, QUERY, "left")
        .select(*QUERY, "word", (share * F.col("max_tf")).alias("least_tf"))
    )
    enough = F.col("tf") >= F.col("least_tf")
    return found.join(_broadcast_if_small(limits, n_terms), ["channel", "word"]).filter(enough).select(*PAIR).distinct()


def search_pages(queries: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """Hits of both page channels with link and title."""
    n_pages = pages.count()
    return once_per_query(
        queries,
        lambda once: page_names(pages).join(_search(once, page_corpus(pages), n_pages, k), "doc_id").withColumn("channel_order", channel_order()),
    )


def channel_order():
    return F.when(F.col("channel") == "title", 0).otherwise(1)


def search_result(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One row per query: hits per channel, or a failure where nothing was found."""
    per = found.groupBy("entity_id").agg(
        F.count("*").alias("n_hits"),
        F.count_if(F.col("channel") == "title").alias("title_hits"),
        F.count_if(F.col("channel") == "body").alias("body_hits"),
    )
    none = F.col("n_hits").isNull()
    zero = F.lit(0).cast("long")
    return queries.select("entity_id").join(per, "entity_id", "left").select(
        "entity_id",
        *[F.coalesce(c, zero).alias(c) for c in ("n_hits", "title_hits", "body_hits")],
        F.when(none, "failed").otherwise("running").alias("status"),
        F.when(none, F.lit(NO_RESULTS)).alias("error"),
    )


def search_links(queries: DataFrame, pages: DataFrame, k: int, interleaved: bool = True, deduplicate: bool = True):
    """Search only: the links to fetch, in order."""
    # unusable links are left out before they are ranked; of the others each channel needs its first k
    store = hits.usable_links(pages.select("page_id", F.col("url").alias("link"), "html"))
    n_pages = store.count()

    def links(once: DataFrame) -> DataFrame:
        best = _search(once, page_corpus(store), n_pages, k)
        found = store.select(F.col("page_id").alias("doc_id"), "link").join(best, "doc_id")
        return hits.select_links(found.withColumn("channel_order", channel_order()), k, interleaved, deduplicate)

    return once_per_query(queries, links)
