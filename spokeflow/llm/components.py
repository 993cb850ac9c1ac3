"""Connected components of a graph given as edges, without gathering any component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeflow.session import checkpointed

# Narrow rows that one task handles; small graphs then take few tasks, and large ones as many as they need.
ROWS_PER_TASK = 100_000


def sized(df: DataFrame, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """In as many partitions as ``rows`` need, or as many as there are."""
    return df.coalesce(max(1, -(-rows // per_task)))


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Link every vertex's neighbours to the smallest of them and itself. ``edges`` go from the larger vertex ``u`` to ``v``.

    The large star moves the larger neighbours, the small star the smaller ones. The least neighbour is combined before the
    shuffle, and both sides of the join are plain shuffles that adaptive execution can split at a hot vertex.
    """
    if large:
        pairs = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        moved = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        return sized(moved, 2 * rows)
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return sized(moved.union(least.select("u", "m")).toDF("u", "v"), 2 * rows)


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``component`` (the smallest vertex reachable) of every vertex with an edge.

    ``edges`` has two columns of any order; loops and repeated edges do no harm, an edge with a NULL is left out. Alternating
    stars end in one star per component after about log(longest path) rounds; each round is cut off from the last one.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    rows = now.count()
    while True:
        now = checkpointed(sized(_star(_star(now, True, rows), False, rows).distinct(), rows))
        rows = now.count()
        # Done when every vertex has one neighbour, or many that have none but it.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            now.select("v", F.lit(0), F.lit(1))
        )
        sides = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if sides.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )
