"""Exact top-k by inner product with the threshold algorithm.

Vectors are dealt into blocks of about ``CANDIDATES`` rows, queries into blocks of
about ``QUERIES``; each pair of blocks is one group.  A group sorts its vectors
once per dimension.  For a query it then reads all these lists from their better
end (from the top for a positive weight, from the bottom for a negative one), a
step deeper each time, and scores every vector that it meets.  The weighted sum
of the values at that depth bounds the score of all vectors not yet met; once it
is below the k-th best score the query is done.  The k best of each block are
merged by rank.

Vectors that are null, or hold null or non-finite components, or have no id take
no part; rows equal in id and vector count once.  A query meets only vectors of its
own length and not those of its own id.  Ties go to the smaller id.  Scores are exact
while they fit 64 bits.  Empty tables give no rows, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_over, prepare

CANDIDATES = 4096
QUERIES = 1024
FIRST_DEPTH = 32


class SortedLists:
    """The vectors of a block with one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # so that equal scores keep the smaller id first
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)
        largest = max(int(np.abs(vectors).max(initial=0)), 1)
        self.exact_float = largest * largest * max(vectors.shape[1], 1) < 1 << 52
        if self.exact_float:  # whole numbers far below 2**53: products by BLAS are exact
            self.vectors = self.vectors.astype(np.float64)

    def best(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors of the block."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        if self.exact_float and np.abs(query).max(initial=0) >= 1 << 20:
            self.exact_float, self.vectors = False, self.vectors.astype(np.int64)
        weights = query.astype(self.vectors.dtype)
        down = query[used] > 0
        met = self.ids == query_id  # its own rows never count
        places, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        done, depth = 0, min(FIRST_DEPTH, n)
        while True:
            if len(used):
                rows = np.where(down, self.order[n - depth : n - done or None, used][::-1], self.order[done:depth, used])
                new = np.zeros(n, bool)
                new[rows.ravel()] = True
                new &= ~met
            else:
                new = ~met
            met |= new
            fresh = np.flatnonzero(new)
            places = np.concatenate([places, fresh])
            scores = np.concatenate([scores, self.vectors[fresh] @ weights])
            top = np.lexsort((places, -scores))[:k]
            places, scores = places[top], scores[top]
            if met.all() or depth >= n:
                break
            edge = np.where(down, self.values[n - depth, used], self.values[depth - 1, used])
            if len(scores) == k and scores[-1] > int(edge @ query[used]):
                break
            done, depth = depth, min(depth * 2, n)
        return self.ids[places], scores.astype(np.int64)


def _block(k: int):
    columns = ["query_nr", "query_id", "vec_id", "score"]

    def task(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame(columns=columns)
        lists = SortedLists(candidates["vec_id"].to_numpy(np.int64), np.stack(candidates["v"].to_numpy()).astype(np.int64))
        found = []
        for nr, query_id, v in zip(queries["nr"], queries["vec_id"], queries["v"]):
            ids, scores = lists.best(np.asarray(v, np.int64), query_id, k)
            found.append(pd.DataFrame({"query_nr": nr, "query_id": query_id, "vec_id": ids, "score": scores}))
        return pd.concat(found, ignore_index=True)[columns]

    return task


def quantised(embeddings: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v, dim``: floor(scale * x) of each component, of the vectors that take part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.filter(F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"),
        F.size(embedding).alias("dim"),
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vectors(vec_id, v, dim)`` and queries of the same form."""
    prepare(vectors.sparkSession)
    vectors = hand_over(vectors.distinct())
    queries = hand_over(queries.distinct().withColumn("nr", F.xxhash64("vec_id", "v")))
    candidate_blocks = -(-max(vectors.count(), 1) // CANDIDATES)
    query_blocks = -(-max(queries.count(), 1) // QUERIES)

    def everywhere(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # each side is copied once for every block of the other
    c = vectors.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(candidate_blocks))).withColumn("qb", everywhere(query_blocks))
    q = queries.withColumn("qb", F.pmod("nr", F.lit(query_blocks))).withColumn("cb", everywhere(candidate_blocks))
    keys = ["dim", "qb", "cb"]
    found = (
        q.groupBy(*keys)
        .cogroup(c.groupBy(*keys))
        .applyInPandas(_block(k), "query_nr long, query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id", "query_nr").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, folder: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
