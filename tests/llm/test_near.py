import random

from llm import brute
import numpy as np
from pyspark.sql import functions as F

from spokeflow.llm import near, slate, words
from spokeflow.llm.components import components


def found(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


def expected(rows):
    return sorted((doc, *rest) for doc, rest in brute.near_components(dict(rows)).items())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def corpus(seed):
    """Exact copies, copies with few and many edits, chains of edits, short texts, and one passage in many texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5_000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n ", "one", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(12):
        text = [word() for _ in range(rng.choice([6, 12, 40, 200, 900]))]
        texts += [" ".join(text)] * rng.randrange(1, 4)
        texts += ["\t".join(edited(rng, text, rng.randrange(1, 8))) for _ in range(6)]
        for _ in range(6):
            text = edited(rng, text, 2)
            texts.append(" ".join(text).upper())
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(2, 40))]) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_are_those_of_all_pairs(documents):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(near.near_duplicates(documents(rows))) == expected(rows)


def test_given_documents(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given("sf0.01", "documents")]
    got = slate.op6_minhash(spark, "/root/testdata/sf0.01")
    assert found(got) == expected(rows)
    assert got.where("kept != (doc_id = component_id)").isEmpty()


def test_one_document_of_each_group_stays(documents):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (3, text + " end"), (7, "else"), (7, "else"), (8, None), (9, ""), (None, text)]
    kept = near.deduplicated(documents(rows))
    assert kept.columns == documents([]).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 7, 8, 9]


def test_empty_table(documents):
    assert near.near_duplicates(documents([])).collect() == []


def test_signatures_agree_as_often_as_the_sets_are_alike():
    rng = np.random.RandomState(0)
    drawn = near.drawn_bins()
    for size in (4, 30, 400):
        agree = []
        for _ in range(60):
            both = np.unique(rng.randint(0, 2**63, size=2 * size).astype(np.uint64) * np.uint64(2))
            rng.shuffle(both)
            a, b = np.sort(both[: size + size // 2]), np.sort(both[size // 2 :])
            s = near.signatures([a, b], drawn)
            agree.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(both))
        assert abs(np.mean(agree)) < 0.06


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7), (200, None)]
    edges += [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.vertex: r.component for r in got.collect()} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_no_group_is_gathered(spark):
    """Stars of a bucket grow with its members, not with their pairs."""
    members = spark.range(2_000).select(F.lit(1).alias("key"), F.col("id").alias("vertex"), F.col("id").alias("component"))
    assert near.star_edges(members).count() == 1_999


def test_pairs_inside_a_hot_bucket_are_found(documents, monkeypatch):
    """Two buckets hold all texts, and each is similar to one other only, which few stars have for a hub."""
    made = near.featured
    hot = F.array(F.lit(7).cast("bigint"), F.lit(8).cast("bigint"))
    monkeypatch.setattr(near, "featured", lambda rows, *which: made(rows, *which).withColumn("bands", hot))
    texts = [" ".join(f"t{n}x{i}" for i in range(20)) for n in range(150)]
    rows = [(n, text) for n, text in enumerate(texts)] + [(1000 + n, text + " end") for n, text in enumerate(texts)]
    assert found(near.near_duplicates(documents(rows))) == expected(rows)


def test_texts_in_one_parted_bucket_are_compared(documents, monkeypatch):
    """The first text is the hub of the only bucket and like neither of the others."""
    made = near.featured
    one = F.array(F.lit(7).cast("bigint"))
    monkeypatch.setattr(near, "featured", lambda rows, *which: made(rows, *which).withColumn("bands", one))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, " ".join(f"h{i}" for i in range(60))), (2, text), (3, text + " more")]
    assert found(near.near_duplicates(documents(rows))) == expected(rows)


def test_prefixes_leave_out_no_similar_pair(spark):
    rng = random.Random(4)
    sets = []
    for _ in range(30):
        base = rng.sample(range(300), rng.choice([1, 3, 4, 12, 40]))
        sets += [sorted({*base, *rng.sample(range(300), rng.randrange(0, 1 + len(base) // 3))}) for _ in range(5)]
    table = spark.createDataFrame(list(enumerate(sets)), "vertex long, shingles array<long>")
    active = table.select("vertex", (F.col("vertex") % 20).alias("component"), F.size("shingles").cast("long").alias("n"))
    pairs = {tuple(r) for r in near.prefix_edges(active, table).collect()}
    alike = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})
    wanted = {(a, b) for b in range(len(sets)) for a in range(b) if a % 20 != b % 20 and alike(a, b)}
    assert wanted and wanted <= pairs
    in_a_bucket = active.select(F.lit(1).alias("key"), "vertex", "component")
    assert {r.vertex for r in near.open_members(in_a_bucket, active.select("vertex", "n")).collect()} >= {x for p in wanted for x in p}


def test_words_that_collide_under_powers_are_not_linked(spark, documents):
    for n in (1_024, 4_096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        one, other = ("".join("ab"[b ^ turn] for b in bits) for turn in (0, 1))
        found = {r.doc_id: r.component_id for r in near.near_duplicates(documents([(1, one), (2, other), (3, one.upper())])).collect()}
        assert found == {1: 1, 2: 2, 3: 1}


def test_block_hashes_tell_words_apart():
    rng = np.random.RandomState(1)
    made = {bytes(rng.randint(97, 99, n).astype(np.uint8)) for n in [*range(1, 30), 7, 8, 9, 15, 16, 17, 1023, 1024, 1025, 3000] for _ in range(20)}
    made |= {w + b"\x00" for w in made} | {b"\x00" * n for n in range(1, 20)}
    made = sorted(made)
    data = np.frombuffer(b" ".join(made), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in made]) - 1
    starts = ends - np.array([len(w) for w in made])
    hashes = words.block_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(made)
    assert (words.block_hashes(data[starts[5] :], starts[5:] - starts[5], ends[5:] - starts[5]) == hashes[5:]).all()
