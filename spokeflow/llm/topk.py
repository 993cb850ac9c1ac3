"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt to shards by a hash of their id, queries to blocks; every shard meets every block in a task of bounded size.
A task sorts each dimension of its shard once. For a query it goes down all lists together, from the end that helps the score:
each vector met is scored in full, and the values reached in the lists bound the score of all vectors not met yet. When that
bound is below the k-th best score, no other vector of the shard can matter. Lists are read in growing steps; a bound equal to
the k-th score does not stop the search, for a vector not met yet might tie with a smaller id.

The best k of each shard and query are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.session import checkpointed

SCALE = 1024
SHARD_ROWS = 16_384
BLOCK_QUERIES = 256
FIRST_DEPTH, GROWTH = 8, 4
FOUND = "query_id bigint, vec_id bigint, score bigint"


def whole(vector: str | Column) -> Column:
    """floor(1024 * x) of each component; NULL for vectors that are NULL or hold NULL, NaN or infinity."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return F.when(vector.isNotNull() & ~bad, scaled)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers, filled up with zeros to one width."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


class Lists:
    """A shard's vectors with each dimension sorted."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # of equal scores, the smaller id comes first
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own."""
        n = len(self.ids)
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        seen = self.ids == own
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, reached = FIRST_DEPTH, 0
        while True:
            depth = min(depth, n)
            if 2 * int(seen.sum()) < n and len(up) + len(down):
                met = np.zeros(n, bool)
                met[self.order[up, reached:depth]] = True
                met[self.order[down, n - depth : n - reached]] = True
                new = np.flatnonzero(met & ~seen)
                bound = (query[up] * self.values[up, depth - 1]).sum() + (query[down] * self.values[down, n - depth]).sum()
            else:  # most rows are known: the rest is scored at once
                new, bound = np.flatnonzero(~seen), None
            seen[new] = True
            rows = np.concatenate((rows, new))
            scores = np.concatenate((scores, self.vectors[new] @ query))
            keep = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[keep], scores[keep]
            if bound is None or depth == n or (len(rows) == k and scores[-1] > bound):
                return self.ids[rows], scores
            reached, depth = depth, depth * GROWTH


def _search(k: int):
    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and queries.num_rows:
            width = max(
                int(np.diff(c.offsets.to_numpy()).max(initial=0))
                for t in (candidates, queries)
                for c in t.column("vector").chunks
            )
            lists = Lists(candidates.column("vec_id").to_numpy(), matrix(candidates.column("vector"), width))
            for own, query in zip(queries.column("vec_id").to_pylist(), matrix(queries.column("vector"), width), strict=True):
                ids, scores = lists.best(query, own, k)
                out += [(own, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        columns = [pa.array([row[i] for row in out], pa.int64()) for i in range(3)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return search


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 10,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best for every row of ``embeddings`` (``vec_id``,
    ``embedding``) that ``is_query`` picks, against all rows but its own; ties go to the smaller ``vec_id``.

    Vectors that are NULL or hold NULL or non-finite components, and rows without ``vec_id``, take no part. Shorter vectors
    count as zero beyond their end. Rows that repeat a ``vec_id`` count once, with the smallest vector.
    """
    usable = embeddings.select(F.col("vec_id").cast("bigint"), whole("embedding").alias("vector"))
    vectors = checkpointed(
        usable.where("vec_id is not null and vector is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    )
    queries = vectors.where(is_query)
    counts = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = -(-counts[0] // shard_rows) or 1, -(-counts[1] // block_queries) or 1
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("shard", part(shards)).withColumn("block", every(blocks))
    right = queries.withColumn("block", part(blocks)).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
