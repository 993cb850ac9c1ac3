import math

import numpy as np
from pyspark.sql import functions as F

from spokeflow.llm import slate, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, k=10):
    """Rows of (vec_id, vector), one per id."""
    whole = {}
    for vec_id, vector in rows:
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            whole[vec_id] = [math.floor(1024 * float(np.float32(x))) for x in vector]
    out = []
    for q in whole:
        if q % 100 == 0:
            scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA)
    got = topk.top_k(table, F.col("vec_id") % 100 == 0, **options)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def test_given_embeddings(spark, given):
    rows = [(r["vec_id"], r["embedding"]) for r in given("sf0.01", "embeddings")]
    got = slate.op9_topk(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain(rows)


def test_ties_copies_and_small_shards(spark):
    rng = np.random.RandomState(4)
    rows = [(i, [0.5, -0.25, 0.0]) for i in range(0, 300)]
    rows += [(i, rng.choice([-0.5, 0.0, 0.25, 1.0], 3).tolist()) for i in range(300, 900)]
    assert found(spark, rows, shard_rows=50, block_queries=2) == plain(rows)


def test_lists_that_stop_early(spark):
    """One long dimension: a few steps down its list decide, and the result is that of all rows."""
    rng = np.random.RandomState(5)
    rows = [(i, [float(rng.pareto(1.0)) + 0.01, *(rng.rand(3) * 0.01).tolist()]) for i in range(1, 3_000)] + [(0, [1.0, 0.0, 0.0, 0.0])]
    assert found(spark, rows) == plain(rows)
    lists = topk.Lists(np.arange(1000), np.arange(1000)[:, None] * np.array([[1, 0]]))
    met = []
    lists.vectors = type("Counted", (), {"__getitem__": lambda self, i: met.extend(i) or (np.asarray(i)[:, None] * np.array([[1, 0]]))})()
    ids, scores = lists.best(np.array([3, 0]), 999, 5)
    assert ids.tolist() == [998, 997, 996, 995, 994] and len(met) < 50


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-1.0, 0.5]), (6, []), (7, [2.0])]
    rows += [(8, [0.0, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, None)]
    assert found(spark, rows) == plain([(i, v and v + [0.0] * (2 - len(v)) if i not in (6,) else [0.0, 0.0]) for i, v in rows])


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [1.0])]) == [(0, 1, 1, 1024 * 1024)]
    assert found(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]) == [(0, 1, 1, 2 * 1024 * 1024)]
