"""The registered queries of the training-data operators: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.llm import bpe, chat, fingerprint, licenses, mixing, near, negatives, quality, repair, rules, topk, urls, wavelet
from spokeflow.llm.oracle import ORACLE
from spokeflow.session import run_dir

__all__ = ["ORACLE", "QUERIES"]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_OF_DOCUMENT = 2
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    tricky = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], conversations.schema)
    found = chat.formatted(conversations.union(tricky)).select(
        "conv_id",
        chat.read_turns("formatted").alias("turns"),
        F.array_join(chat.read_loss("formatted", "spans"), "").alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_string("sketch").alias("fingerprint"),
        fingerprint.as_string("edited_sketch").alias("edited_fingerprint"),
        fingerprint.likeness("sketch", "edited_sketch").alias("near_edited"),
        fingerprint.likeness("sketch", "next_sketch").alias("near_next"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text", TOKENIZER).alias("made"))
    return made.select(
        "doc_id",
        bpe.token_count("made.ids").alias("n_tokens"),
        F.sha2("made.ids", 256).alias("ids_sha256"),
        "made.decoded_sha256",
    )


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "tokens")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, TOKENIZER, END_OF_DOCUMENT)
    return wavelet.document_index(wavelet.read_shards(spark, path))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classified(documents, table(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(embeddings.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair_digest(repair.damaged(conversations), conversations)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_licenses, op2_chat, op3_fingerprints, op4_bpe, op5_wavelet, op6_minhash, op7_mixing, op8_quality, op9_topk,
        op10_urls, op11_rules, op12_negatives, op13_repair,
    )
}
