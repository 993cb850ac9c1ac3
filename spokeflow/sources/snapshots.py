"""Landed feed documents: one poll's JSON per file, or one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.functions import decode


def read_documents(
    spark: SparkSession,
    path: str,
    feed: Column | None = None,
    ingested_at: Column | None = None,
    one_per_line: bool = False,
    streaming: bool = False,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """(feed, ingested_at, document), batch or streaming.

    ``ingested_at`` defaults to the file's landing time and ``feed`` to its folder; both may instead be read from
    ``document``, ``value`` or ``_metadata``. Unknown fields survive, since the document is kept as a variant; text
    that is not JSON gives a NULL document. Land one document per line for files that Spark can split.
    """
    reader = spark.readStream if streaming else spark.read
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.format("text").option("wholetext", not one_per_line).load(path).select("value", "_metadata")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    return lines.withColumn("document", decode.document(F.col("value"))).select(
        (folder if feed is None else feed).alias("feed"),
        (F.col("_metadata.file_modification_time") if ingested_at is None else ingested_at).alias("ingested_at"),
        "document",
    )


def read_information(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Metadata documents: the feed's name, its own ``last_updated`` and the document."""
    documents = read_documents(spark, path, feed=F.lit(source))
    return documents.withColumn("last_updated", decode.field(F.col("document"), "last_updated", "bigint"))
