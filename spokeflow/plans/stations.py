"""The station pipeline end to end, in batch and live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spokeflow.functions.sizing import broadcast_if_small
from spokeflow.operators import records
from spokeflow.operators.changes import changed
from spokeflow.operators.enrich import enrich
from spokeflow.operators.upsert import latest
from spokeflow.schemas import CURRENT_STATUS
from spokeflow.sinks.serving import Question, serve
from spokeflow.sinks.upsert import UpsertTable
from spokeflow.streaming.changes import ChangeFilter, parquet_publisher
from spokeflow.streaming.current import current_status
from spokeflow.streaming.run import POLL_INTERVAL, start


def status_rows(documents: DataFrame) -> DataFrame:
    """Typed records of all documents with ``reject_reason`` and ``unreadable``; a rejected document is one row."""
    flagged = records.with_document_reason(documents).withColumnRenamed("reject_reason", "document_reason")
    rows = records.explode_status(flagged)
    return rows.withColumn("reject_reason", F.coalesce("document_reason", "reject_reason"))


def poll_rows(rows: DataFrame) -> DataFrame:
    """What the change filter reads: all records of readable documents.

    A record without a station, like the one row of an empty poll, only tells that its poll took place.
    """
    return rows.where("document_reason is null").drop("document_reason", "reject_reason", "unreadable")


def status_records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed records of all readable documents, and what is set aside or reported, with the reason."""
    rows = status_rows(documents)
    accepted = rows.where("reject_reason is null").drop("document_reason", "reject_reason", "unreadable")
    return accepted, records.issues(rows)


def status_log(documents: DataFrame, staging: str | None = None) -> DataFrame:
    """The change-only status log of landed polls.

    With ``staging``, the documents are decoded once into that folder, and the log reads the few columns it needs from there;
    :func:`log_issues` reads the rejects from it.
    """
    rows = status_rows(documents)
    if staging:
        rows.write.mode("overwrite").parquet(staging)
        rows = documents.sparkSession.read.parquet(staging)
    return changed(poll_rows(rows))


def log_issues(spark: SparkSession, staging: str) -> DataFrame:
    """Rejected and reported records of a staged status log."""
    return records.issues(spark.read.parquet(staging))


def current_table(log: DataFrame, information: DataFrame) -> DataFrame:
    """Last status of each station with its metadata."""
    status = latest(log, "station_id", ("ingested_at", "pos"))
    needed = information.select("key", *[name for name, side, _ in CURRENT_STATUS if side == "info"])
    return enrich(status, broadcast_if_small(needed))


def start_change_filter(
    documents: DataFrame, path: str, publish, every: str | None = POLL_INTERVAL, report=None, aside=None
) -> StreamingQuery:
    """Documents that land become published changes; ``report`` takes each batch's counts per poll, ``aside`` what is
    rejected or reported. By default that is kept under ``path``, in ``issues``."""
    aside = aside or parquet_publisher(f"{path}/issues")
    step = ChangeFilter(f"{path}/states", publish, report=report, late=parquet_publisher(f"{path}/late"))

    def process(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            aside(records.issues(rows), batch_id)
            step.process(poll_rows(rows), batch_id)
        finally:
            rows.unpersist()

    return start(status_rows(documents), process, f"{path}/checkpoint", every=every)


def start_current_table(
    status: DataFrame,
    information: DataFrame,
    path: str,
    every: str | None = POLL_INTERVAL,
    questions: dict[str, Question] | None = None,
) -> tuple[StreamingQuery, UpsertTable]:
    """Status and metadata changes keep the current status table, and the answers to ``questions``, up to date."""
    table = UpsertTable(f"{path}/current_status", ("station_id",))
    apply = serve(table, f"{path}/serving", questions or {})
    return start(current_status(status, information), apply, f"{path}/checkpoint", "update", every), table

