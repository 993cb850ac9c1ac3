"""Keyed message logs: a Kafka topic, or files with ``key`` and ``value`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.functions import decode
from spokeflow.operators.records import decode_information
from spokeflow.operators.upsert import latest
from spokeflow.schemas import STATUS_FIELDS

FILE_SCHEMA = "key binary, value binary"
# Where a message stands in its log: a message's offset (a key stays in one partition), or for files a rising number that the
# writer of the log adds.
POSITIONS = ("offset", "position")


def log_position(columns: Sequence[str]) -> tuple[str, ...]:
    """The columns that order a log's messages of one key; none if the log has no position."""
    return tuple(c for c in POSITIONS if c in columns)[:1]


def read_messages(
    spark: SparkSession, format: str, streaming: bool = False, schema: str = FILE_SCHEMA, framed: bool = False, **options
) -> DataFrame:
    """Messages with text ``key`` and ``value``, from the start of the log.

    ``format="kafka"`` needs the connector on the class path and ``subscribe`` among the options; any file format
    needs ``path``. Extra columns of the source (offset, timestamp) are kept.
    """
    reader = (spark.readStream if streaming else spark.read).format(format)
    if format == "kafka":
        reader = reader.option("startingOffsets", "earliest")
    else:
        reader = reader.schema(schema)
    rows = reader.options(**options).load()
    return rows.withColumns(
        {"key": decode.text(F.col("key")), "value": decode.text(F.col("value"), framed)}
    )


def status_events(messages: DataFrame) -> DataFrame:
    """Status messages as typed status events with the whole ``payload``."""
    p = F.col("payload")
    typed = [decode.field(p, n, t).alias(n) for n, t in STATUS_FIELDS.items()]
    rest = [F.col(c) for c in messages.columns if c not in ("key", "value")]
    ingested_at = decode.iso_instant(decode.field(p, "ingested_at", "string"))
    return messages.withColumn("payload", decode.document(F.col("value"))).select(
        decode.field(p, "station_id", "string").alias("station_id"), ingested_at.alias("ingested_at"), *typed, "payload", *rest
    )


def station_information(messages: DataFrame, version: tuple[str, ...] = ()) -> DataFrame:
    """The metadata topic as an upsert table: the last message per key wins, one without a value deletes.

    The order is that of the log. Without a position, ``version`` must name other columns; a time in the payload orders no
    deletes, which have no payload, and leaves writes of one second undecided.
    """
    order = log_position(messages.columns) or tuple(version)
    if not order:
        raise ValueError(f"the log has none of {POSITIONS}; name the columns that order it")
    rows = decode_information(messages)
    return latest(rows, "key", order, deleted=F.col("deleted")).drop("deleted")
