"""Keyed JSON messages out of status and metadata records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.functions import encode


def status_messages(changed: DataFrame) -> DataFrame:
    """Key and JSON of changed stations: all feed fields, plus when they were read."""
    at = F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return _messages(changed, {"ingested_at": at})


def information_messages(records: DataFrame, source: str, ingested_at: Column | None = None) -> DataFrame:
    """Key and JSON of station metadata, with the load time in epoch seconds and the source it came from."""
    now = F.unix_timestamp() if ingested_at is None else ingested_at
    return _messages(records, {"_ingested_at": now, "_source": F.lit(source)})


def _messages(records: DataFrame, added: dict[str, Column]) -> DataFrame:
    return records.select(
        encode.utf8(F.col("station_id")).alias("key"),
        encode.utf8(encode.json_text(encode.merged(F.col("payload"), added))).alias("value"),
    )


def publish(messages: DataFrame, format: str, **options) -> None:
    """Append to the log; with Kafka the key places a station's messages in one partition."""
    messages.write.format(format).mode("append").options(**options).save()
