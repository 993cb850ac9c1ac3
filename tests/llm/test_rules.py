import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow.llm import rules, slate

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def plain_statistics(text):
    """By the names of the conditions."""
    n_words, chars, symbols, dups, repeats = plain_counts(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    count = lambda signs: sum(c in signs for c in text)
    return {
        "symbols": 1000 * symbols // chars, "upper": 1000 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") // chars,
        "digits": 1000 * count("0123456789") // chars, "calls": 1000 * count("!?") // chars,
        "repeat_words": 1000 * repeats // n_words, "echoes": 1000 * sum(a == b for a, b in zip(words, words[1:])) // n_words,
        "dup_lines": 1000 * dups // len(lines),
        "word_length": min(1000, 10 * chars // n_words),
    }


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, quality int, toxic int")


def test_counts_and_verdicts_of_given_documents(spark, given):
    """Against plain Python: the counts, the base limits, and the list applied rule by rule."""
    got = {r.doc_id: r for r in slate.op11_rules(spark, "/root/testdata/sf0.01").collect()}
    texts = {r["doc_id"]: r["text"] for r in given("sf0.01", "documents")}
    assert got.keys() == texts.keys()
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    found = rules.learned(rules.with_counts(documents), labels)
    assert found.rules and found == rules.learned(rules.with_counts(documents), labels)
    for doc_id, r in got.items():
        counts = plain_counts(texts[doc_id])
        assert tuple(r[c] for c in COUNTS) == counts and r.base_failed == plain_failed(counts)
        first = None
        if not r.base_failed:
            values = plain_statistics(texts[doc_id])
            meets = lambda c: values[c.statistic] >= c.threshold if c.at_least else values[c.statistic] <= c.threshold  # noqa: E731, B023
            first = next((i for i, rule in enumerate(found.rules, 1) if all(map(meets, rule.conditions))), None)
        assert (r.rule, r.kept) == (first, not r.base_failed and first is None)


def test_held_out_accuracy(spark, given):
    got = {r.doc_id: r for r in slate.op11_rules(spark, "/root/testdata/sf0.1").collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in given("sf0.1", "labels") if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    judged = [(r.kept, q) for r, q in held if not r.base_failed]
    assert len(judged) > 300
    assert np.mean([kept for kept, q in judged if q == 1]) > 0.98
    assert np.mean([kept == (q == 1) for kept, q in judged]) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    counted = rules.with_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = known.withColumn("quality", F.when(rules.held_out("doc_id"), 1 - known.quality).otherwise(known.quality))
    assert rules.learned(counted, known) == rules.learned(counted, turned)


def tally(rows):
    out = {}
    for x, bad in rows:
        for i, v in enumerate(x):
            b, g = out.get((i, v), (0, 0))
            out[i, v] = (b + bad, g + (not bad))
    return out


def test_best_condition_is_that_of_all_thresholds():
    rng = random.Random(5)
    names = [s[0] for s in rules.STATISTICS]
    for _ in range(200):
        rows = [([rng.randint(0, 12) for _ in names], rng.random() < 0.4) for _ in range(rng.randint(1, 40))]
        bad, good = sum(b for _, b in rows), sum(not b for _, b in rows)
        best = 0.0
        for i in range(len(names)):
            for at_least in (True, False):
                for t in range(14):
                    took = [b for x, b in rows if (x[i] >= t if at_least else x[i] <= t)]
                    if sum(took) and len(took) < len(rows):
                        gain = sum(took) * (np.log2(sum(took) / len(took)) - np.log2(bad / (bad + good)))
                        best = max(best, gain)
        found = rules.best_condition(tally(rows))
        if best < 1e-9:
            assert found is None
            continue
        condition, p, n = found
        i = names.index(condition.statistic)
        took = [b for x, b in rows if (x[i] >= condition.threshold if condition.at_least else x[i] <= condition.threshold)]
        assert (sum(took), len(took) - sum(took)) == (p, n)
        assert abs(p * (np.log2(p / (p + n)) - np.log2(bad / (bad + good))) - best) < 1e-6


def counted(spark, rows):
    """Rows of (_bad, _grow, n_symbols, n_upper) out of 1000 characters."""
    zero = {c: 0 for c in (*rules.COUNTS, *rules.MORE_COUNTS)}
    made = [{**zero, "word_chars": 1000, "_bad": b, "_grow": g, "n_symbols": s, "n_upper": u} for b, g, s, u in rows]
    return spark.createDataFrame(made, ", ".join(["_bad boolean", "_grow boolean", *[f"{c} long" for c in zero]]))


def test_grows_conjunctions_and_covers_what_is_left(spark):
    """Junk has many symbols and no capitals, or very many capitals; many of either alone is no fault."""
    rng = random.Random(9)
    rows = []
    for _ in range(1_500):
        s, u = rng.randint(0, 300), rng.randint(0, 300)
        rows.append(((s >= 200 and u < 50) or u >= 280, rng.random() < 0.67, s, u))
    found = rules.covering(counted(spark, rows))
    for bad, _, s, u in rows:
        value = {"symbols": s, "upper": u}
        meets = lambda c: value[c.statistic] >= c.threshold if c.at_least else value[c.statistic] <= c.threshold  # noqa: E731, B023
        assert any(all(map(meets, r.conditions)) for r in found.rules) == bad
    assert any(len(r.conditions) == 2 for r in found.rules) and str(found.rules[0]).startswith("reject if ")


def test_prunes_what_only_the_growing_part_shows(spark):
    """In the growing part a second condition looks better by chance; the pruning part does not bear it out."""
    rows = [(True, True, 100, 10)] * 20 + [(False, True, 100, 90)] * 2 + [(False, True, 0, 10)] * 50
    rows += [(True, False, 100, u) for u in range(0, 200, 10)] + [(False, False, 0, 10)] * 20
    found = rules.covering(counted(spark, rows))
    assert [[c.statistic for c in r.conditions] for r in found.rules] == [["symbols"]]
    assert (found.rules[0].right, found.rules[0].wrong) == (20, 0)


def test_without_a_rule(spark, documents, labels):
    text = " ".join(f"word{i}" for i in range(60))
    rows = documents([(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text), (5, "a " * 60)])
    for known in ([], [(1, 1), (2, 1)], [(1, 0), (2, 0)], [(1, None), (2, 7), (None, 0)], [(1, 0), (2, 1)]):
        got = rules.judged(rows, labels(known)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in got) == [
            (False, 1, 60, False, True), (False, 2, 60, False, True), (False, 2, 60, False, True), (False, 3, 0, True, False),
            (False, 4, 0, True, False), (False, 5, 60, True, False), (True, 0, 60, False, True),
        ]
    assert rules.judged(documents([]), labels([])).collect() == []


def test_counts_of_odd_texts(spark, documents):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "x y z x y z", "A\x0bB\x0cC\r\nD", "é ñ 日本　語 😀 # $", "a\n\na\n a\n", "\x1c\x1d a"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) + rng.choice(["", "\n", "\n\n b |"]) * 3 for _ in range(60)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(400)), "long " * 30_000, "w" * 200_000]
    rows = documents(list(enumerate(texts)))
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in rules.with_counts(rows).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_clean_rows_stay_and_junk_goes(spark, documents):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = [r.text for r in table.join(known.where("quality = 1"), "doc_id").where("n_chars > 1500").orderBy("doc_id").limit(20).collect()]
    shapes = [
        lambda w: [x + "$%&#*"[i % 5] * 3 for i, x in enumerate(w)],
        lambda w: [y for x in w for y in (x, "|")],
        lambda w: w[:60] * 4,
    ]
    rows = [(10**6 + i, t) for i, t in enumerate(good)] + [(None, good[0])]
    junk = [(2 * 10**6 + i, " ".join(shape(good[4].split()[:200]))) for i, shape in enumerate(shapes)]
    kept = rules.accepted(table.unionByName(documents(rows + junk).drop("score")), known)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {i for i, _ in rows} - ids == set() and {i for i, _ in junk} & ids == set()
