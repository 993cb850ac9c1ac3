import hashlib

from llm import brute
import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from spokeflow.llm import slate

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, given, path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{path}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == DOCUMENTS
        kept.append(docs.collect())
    accepted, distinct, mixed, tokens = kept
    labels = {r["doc_id"]: r["quality"] for r in given("sf0.01", "labels")}
    accepted_ids = {r.doc_id for r in accepted}
    assert np.mean([(i in accepted_ids) == q for i, q in labels.items()]) > 0.98
    groups = brute.near_components({r.doc_id: r.text for r in accepted})
    assert sorted(r.doc_id for r in distinct) == sorted(i for i, (_, c) in groups.items() if c == i)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in distinct}
    library = Tokenizer.from_file(slate.TOKENIZER)
    texts = {r.doc_id: r.text for r in mixed}
    assert len(tokens) == len(mixed)
    for r in tokens:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_registered(spark):
    queries = contract.queries()
    assert {n for n in queries if n.startswith("op")} == set(slate.QUERIES)
    assert queries["pipeline"](spark, "/root/testdata/sf0.001").count() > 50


def test_empty_documents(spark, path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 0")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{path}/{number}")
        docs = spark.read.parquet(f"{path}/{number}")
    assert docs.count() == 0
