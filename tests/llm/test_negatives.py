import math

import numpy as np
from pyspark.sql import functions as F

from spokeflow.llm import negatives, slate

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, cell string"


def plain(rows):
    """Rows of (vec_id, vector, label), one per id."""
    whole = {}
    for vec_id, vector, label in rows:
        if None not in (vec_id, vector, label) and all(x is not None and math.isfinite(x) for x in vector):
            whole[vec_id] = ([math.floor(256 * float(np.float32(x))) for x in vector], label)
    out = []
    for a, (anchor, label) in whole.items():
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(anchor, v)), i, l) for i, (v, l) in whole.items() if i != a]
        for p, positive, _ in sorted(s for s in scores if s[2] == label)[:5]:
            fit = sorted(s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fit[:3], 1)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, l, "clash", "clash") for i, v, l in rows], SCHEMA)
    got = negatives.hard_negatives(table, F.col("vec_id") % 50 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def clusters(n, rng, width=6):
    centres = rng.randn(8, width)
    return [(i, (centres[i % 8] * (1 + i % 3) + rng.randn(width) * 0.3).tolist(), int(rng.randint(3))) for i in range(n)]


def test_given_embeddings(spark, given):
    moved = lambda r: (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
    rows = [(r["vec_id"], r["embedding"], moved(r)) for r in given("sf0.01", "embeddings")]
    assert sorted(map(tuple, slate.op12_negatives(spark, "/root/testdata/sf0.01").collect())) == plain(rows)


def test_many_cells_and_shards(spark):
    """Upper levels of several nodes, and all three visits."""
    rows = clusters(1_500, np.random.RandomState(1))
    assert found(spark, rows, shard_rows=20, sample=300, cells=60) == plain(rows)


def test_copies_ties_and_lengths(spark):
    rng = np.random.RandomState(2)
    rows = [(i, [0.5, -0.25, 0.0], i % 2) for i in range(300)]
    rows += [(i, rng.choice([-0.5, 0.0, 0.25, 1.0], 3).tolist(), i % 3) for i in range(300, 700)]
    rows += [(i, (rng.randn(3) * 10.0 ** rng.randint(-2, 3)).tolist(), i % 4) for i in range(700, 1_000)]
    assert found(spark, rows, shard_rows=30, sample=100) == plain(rows)
    assert found(spark, rows) == plain(rows)


def test_subtrees_are_left_out():
    """Clusters far apart: windows are compared with few of the rows, and the result is that of all rows."""
    rng = np.random.RandomState(3)
    centres = rng.randn(20, 16) * 256
    vectors = np.floor(centres[np.arange(6_000) % 20] + rng.randn(6_000, 16) * 8).astype(np.int64)
    labels = rng.randint(0, 3, 6_000)
    sphere = negatives.Sphere(16, float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max())))
    search = negatives.Search(sphere, np.arange(6_000), labels, vectors)
    some = np.arange(100)
    far = np.full(100, 1 << 62)
    scores, ids = search.best(vectors[some], some, labels[some], some, -far, far, True, 5)
    assert search.scored < 0.4 * 100 * 6_000
    for a in some:
        own = vectors @ vectors[a]
        fit = sorted((-own[i], i) for i in range(6_000) if i != a and labels[i] == labels[a])[:5]
        assert [(-s, i) for s, i in zip(scores[a], ids[a])] == fit
    edges = [np.ceil(scores[:, 0] * p).astype(np.int64) for p in (0.5, 0.95)]
    search.scored = 0
    scores, ids = search.best(vectors[some], some, labels[some], some, *edges, False, 3)
    for a in some:
        own = vectors @ vectors[a]
        fit = sorted((-own[i], i) for i in range(6_000) if labels[i] != labels[a] and edges[0][a] <= own[i] <= edges[1][a])[:3]
        assert [(-s, i) for s, i in zip(scores[a], ids[a]) if i != negatives.NO_ID] == fit


def test_products_beyond_doubles():
    big = np.array([[1 << 30, 1], [1 << 30, -1]])
    assert negatives.exact(big).dtype == np.int64 and negatives.exact(big >> 20).dtype == float
    sphere = negatives.Sphere(2, float(np.sqrt(2.0**60 + 1)))
    search = negatives.Search(sphere, np.array([1, 2]), np.array([0, 0]), big)
    wide = np.array([1 << 62])
    scores, ids = search.best(big[:1], np.array([9]), np.array([0]), np.array([0]), -wide, wide, True, 2)
    assert ids.tolist() == [[1, 2]] and scores.tolist() == [[(1 << 60) + 1, (1 << 60) - 1]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [nan, 1.0], 1), (4, [-inf, 1.0], 2), (5, [1.0, 0.5], 1)]
    rows += [(6, [], 1), (7, [2.0], 2), (8, [0.0, 0.0], 2), (None, [1.0, 1.0], 1), (9, [1.0, 1.0], None), (50, [0.0, 0.0], 1)]
    rows += [(10, [0.5, 0.7], 2), (11, [-1.0, -2.0], 1), (100, [1.0, 2.0], 7), (150, None, 1)]
    filled = [(i, v if v is None else v + [0.0] * (2 - len(v)), l) for i, v, l in rows]
    assert found(spark, rows) == plain(filled)
    assert found(spark, rows, shard_rows=1) == plain(filled)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (2, [0.9], 2)]) == [(0, 1, 1, 2, 65536, 230 * 256)]
