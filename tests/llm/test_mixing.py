import re

import pytest
from pyspark.sql import functions as F

from spokeflow.llm import mixing, slate


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share out all words by weight again and again until no source is over its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left, total = {}, set(sizes), sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        each = rest / (sum(weight[s] for s in left) or 1)
        over = {s for s in left if each * weight[s] > cap * sizes[s]}
        if not over:
            return {**fixed, **{s: each * weight[s] for s in left}}
        fixed |= {s: cap * sizes[s] for s in over}
        left -= over


def check(rows, found, near=30):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], abs=1e-6)
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= max(near, 0.002 * targets[source]), source


def test_given_documents(spark, given):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in given("sf0.01", "documents")]
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.mixture(documents).collect()
    check(rows, first)
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, mixing.mixture(documents.repartition(3)).collect()), key=repr)
    assert set(slate.op7_mixing(spark, "/root/testdata/sf0.001").columns) == {"doc_id", "size", "source_size", "target", "taken"}


def test_hot_and_tiny_sources(documents):
    rows = [(i, "w " * (i % 40), "hot") for i in range(3_000)]
    rows += [(10_000 + i, "x y z " * 5, f"s{i % 3}") for i in range(60)]
    rows += [(20_000, "one", "tiny"), (20_001, "a b c d e f g h i j k l", "small"), (20_002, "", "none"), (20_003, None, None)]
    rows += [(20_004, "n " * 50, None), (20_005, "same text", "twin"), (20_005, "same text", "twin"), (None, "no id", "twin")]
    check(rows, mixing.mixture(documents(rows)).collect())


def test_many_shards(documents):
    rows = [(i, "w " * (5 + i % 90), "big" if i % 3 else "b2") for i in range(2_000)]
    sizes = documents(rows).select("doc_id", "source", mixing.word_count().alias("size"))
    check(rows, mixing.mix(sizes, shard_words=2_000, shard_rows=100).collect(), near=200)


def test_a_long_document(documents):
    rows = [(1, "w " * 20_000, "a"), (2, "w " * 10, "a"), (3, "w " * 30_000, "b")]
    check(rows, mixing.mixture(documents(rows)).collect())


def test_no_words_at_all(documents):
    assert [(r.size, r.target, r.taken) for r in mixing.mixture(documents([(1, "", "a"), (2, None, None)])).collect()] == [
        (0, 0.0, 0)
    ] * 2
    assert mixing.mixture(documents([])).collect() == []


def seats_by_quotients(claims, seats, caps):
    won = [0] * len(claims)
    for _ in range(seats):
        open_ = [i for i in range(len(claims)) if won[i] < caps[i] and claims[i] > 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (claims[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_quotas_are_the_highest_quotients(spark):
    cases = [
        ([53.0, 24.0, 23.0], 7, [99] * 3), ([1.0] * 9, 4, [9] * 9), ([100.0, 1.0, 1.0, 1.0], 10, [99] * 4),
        ([5.5, 0.0, 3.1], 8, [2, 5, 9]), ([1000.0, 999.0, 1.0, 0.2], 321, [500] * 4), ([3.0, 2.0], 50, [4, 5]),
    ]
    rows = [(g, i, c, s, caps[i]) for g, (claims, s, caps) in enumerate(cases) for i, c in enumerate(claims)]
    parties = spark.createDataFrame(rows, "g int, i int, _claim double, _seats long, _cap long")
    found = {(r.g, r.i): r.q for r in mixing.apportion(parties, ["g"], ["g", "i"], "q").collect()}
    for g, (claims, seats, caps) in enumerate(cases):
        assert [found[g, i] for i in range(len(claims))] == seats_by_quotients(claims, seats, caps), g


def test_the_mix_as_rows(documents):
    rows = [(i, "w " * (20 + i % 30), f"s{i % 4}") for i in range(400)]
    table = documents(rows)
    mixed = mixing.mixed(table)
    assert mixed.columns == table.columns
    words = sum(len(t.split()) for _, t, _ in rows)
    assert abs(mixed.agg(F.sum(F.regexp_count("text", F.lit("w")))).first()[0] - words) < 0.03 * words


def test_no_python_in_the_plan(spark):
    plan = slate.op7_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
