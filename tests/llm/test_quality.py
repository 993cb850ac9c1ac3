import zlib

import numpy as np
import pytest

from spokeflow.llm import quality, slate

SHAPES = {
    "signs": lambda w: [x + "$%&#*"[i % 5] * 3 for i, x in enumerate(w)],
    "shouting": lambda w: [x.upper() + "!!" for x in w],
    "table": lambda w: [y for x in w for y in (x, "|")],
    "repeats": lambda w: [x for x in w[::12] for _ in range(12)],
}


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, given):
    found = {r.doc_id: r for r in slate.op8_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["quality"] for r in given("sf0.1", "labels")}
    for doc_id, r in found.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(found[i].predicted, q) for i, q in labels.items() if found[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.98
    assert np.mean([p for p, q in held if q == 1]) > 0.98


def test_labels_of_held_out_rows_are_not_used(spark, labels):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = known.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - known.quality).otherwise(known.quality))
    one, two = (sorted(map(tuple, quality.classified(documents, l).collect())) for l in (known, turned))
    assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in two]
    assert np.allclose([r[2] for r in one], [r[2] for r in two])


def test_without_labels_of_both_classes(documents, labels):
    rows = documents([(1, "some text"), (1, "some text"), (2, None), (None, "")])
    for known in ([], [(1, 1), (2, None)]):
        assert [(r.score, r.predicted) for r in quality.classified(rows, labels(known)).collect()] == [(0.5, 1)] * 4
    assert quality.classified(documents([]), labels([])).collect() == []


def test_clean_rows_stay_and_junk_goes(spark, documents):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = [r.text for r in table.join(known.where("quality = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    good = [t for t in good if len(t) > 1500 and "@" not in t]
    rows = [(10**6 + i, t) for i, t in enumerate([good[0] + "\n" + good[1], "\n".join(good * 5), good[2][:400], good[3].split("\n")[0]])]
    junk = [(10**6 + 10 + i, " ".join(shape(good[4].split()[:200]))) for i, shape in enumerate(SHAPES.values())]
    mixed = table.unionByName(documents(rows + junk).drop("score"))
    kept = {r.doc_id for r in quality.accepted(mixed, known).select("doc_id").collect()}
    assert {i for i, _ in rows} <= kept
    assert not {i for i, _ in junk} & kept


def test_scores_are_the_density_ratio(spark):
    rng = np.random.RandomState(1)
    p = len(quality.FEATURES)
    x = np.concatenate([rng.randn(300, p), rng.randn(200, p) * 2 + 1])
    y = [1] * 300 + [0] * 200
    rows = spark.createDataFrame([(l, list(map(float, v))) for l, v in zip(y, x)], "label int, x array<double>")
    model = quality.fit(rows, pooled=0.1, spherical=0.05)
    own = [np.cov(x[np.array(y) == c].T, bias=True) for c in (0, 1)]
    both = 0.4 * own[0] + 0.6 * own[1]
    logs = []
    for c, prior in ((0, 0.4), (1, 0.6)):
        s = 0.9 * own[c] + 0.1 * both
        s = 0.95 * s + 0.05 * np.trace(s) / p * np.eye(p)
        d = x - x[np.array(y) == c].mean(axis=0)
        logs.append(np.log(prior) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))
