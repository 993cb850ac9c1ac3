"""Serving tables: the current status table and what is asked of it, refreshed with every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spokeflow.sinks.folders import finished, remove_below
from spokeflow.sinks.upsert import UpsertTable

Question = Callable[[DataFrame], DataFrame]


def serve(table: UpsertTable, path: str, questions: dict[str, Question]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: apply the batch to the table, then answer each question from the table as of that batch."""

    def apply(rows: DataFrame, batch_id: int) -> None:
        table.write_batch(rows, batch_id)
        now = table.read(rows.sparkSession, batch_id)
        for name, question in questions.items():
            question(now).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            # The answer before stays: its readers are not disturbed by this one.
            remove_below(rows.sparkSession, f"{path}/{name}", batch_id - 1)

    return apply


def answer(spark: SparkSession, path: str, name: str, batch_id: int | None = None) -> DataFrame:
    """The newest answer, or the one that batch ``batch_id`` left; the last two are kept."""
    if batch_id is None:
        known = finished(spark, f"{path}/{name}")
        if not known:
            raise FileNotFoundError(f"{name} has not been answered yet")
        batch_id = known[-1]
    return spark.read.parquet(f"{path}/{name}/batch={batch_id}")
