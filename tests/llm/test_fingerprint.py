import hashlib
import random

from pyspark.sql import functions as F

from spokeflow.llm import fingerprint, slate


def plain_edits(rows):
    """{doc_id: (n_chars, sha)} of distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for at, (doc_id, text) in enumerate(rows):
        after, cut = rows[(at + 1) % len(rows)][1], len(text) // 3
        out[doc_id] = len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
    return out


def test_given_documents(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given("sf0.001", "documents")]
    found = slate.op3_fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == plain_edits(rows)
    texts = dict(rows)
    by_text = {}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in found if r.n_chars > 2000]
    assert all(r.near_edited > 0.4 for r in long)


def test_odd_rows(documents):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "x y z"), (5, "é " * 4000), (None, None)]
    found = fingerprint.fingerprints(documents(rows))
    assert sorted((r.doc_id or -1, r.text) for r in found.collect()) == sorted((i or -1, t or "") for i, t in rows)
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[1].edited == "a b c d e" + ("x y " if by_id[1].edited.endswith("x y ") else "")
    assert by_id[2].sketch == [] and len(by_id[5].sketch) == 1


def test_one_row_and_none(documents):
    (row,) = fingerprint.fingerprints(documents([(1, "abcdef")])).collect()
    assert row.edited == "abcdab"
    assert fingerprint.fingerprints(documents([])).collect() == []


def test_containment_merge_and_text_form(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:600])), (2, " ".join(words[3000:]))]
    sketched = fingerprint.with_sketch(spark.createDataFrame(rows, "n int, text string"), "text", "s")
    whole, part, rest = (r.s for r in sketched.orderBy("n").collect())
    assert 0.2 < len(whole) / 6000 < 0.3
    two = spark.createDataFrame([(whole, part, rest)], "a array<bigint>, b array<bigint>, c array<bigint>")
    near, apart, same, text = two.select(
        fingerprint.likeness("a", "b"), fingerprint.likeness("b", "c"), fingerprint.likeness("a", "a"),
        fingerprint.from_string(fingerprint.as_string("a")) == F.col("a"),
    ).first()
    assert (near, apart, same, text) == (1.0, 0.0, 1.0, True)
    merged = two.select(fingerprint.merged("b", "c")).first()[0]
    assert set(merged) == set(part) | set(rest)


def test_no_python_in_the_plan(spark):
    plan = slate.op3_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
