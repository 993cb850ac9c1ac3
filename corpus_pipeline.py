"""A training corpus from raw documents: quality, near-duplicates, mixing, tokens. Part of the subpackage ``llm``.

Each stage works on all rows that the one before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.llm import bpe, mixing, near, quality
from spokeflow.session import run_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Learning and encoding run in Python: not expressible in SQL, tested against plain versions.
ORACLE_SQL = None


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels of ``docs`` outside the held-out part."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest ``doc_id``."""
    return near.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources to their target weights; a document comes as often as the mix takes it, which may be never."""
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, packed and by digest, and the digest of the text decoded from them."""
    made = docs.select("doc_id", "source", bpe.round_trip("text", TOKENIZER, keep=False).alias("made"))
    return made.select(
        "doc_id",
        "source",
        bpe.token_count("made.ids").alias("n_tokens"),
        "made.ids",
        F.sha2("made.ids", 256).alias("ids_sha256"),
        "made.decoded_sha256",
    )


STAGES = [
    ("quality classifier", accepted),
    ("MinHash near-dedup", deduplicated),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = run_dir(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
