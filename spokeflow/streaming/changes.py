"""The change filter over landed polls.

Polls are expected to land in time order, as one poller per feed writes them. A poll may be spread over micro-batches. One that
comes after a newer poll of its feed has been seen is late: what came before it is gone, so it is set aside, not published.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.operators.changes import POLL, flag_changes, number_polls, poll_counts
from spokeflow.operators.upsert import latest
from spokeflow.schemas import TRACKED_FIELDS


@dataclass(frozen=True)
class ChangeFilter:
    """Publishes changed stations and keeps the last two polls of each feed between micro-batches: the newest may go on in
    the next one, and is then still compared with the one before it.

    ``path`` holds two slots used in turn: batch n reads the slot that batch n-1 wrote and replaces the other, so a
    replayed batch gives the same answer. The slot is written after publishing: a failed publish is tried again.
    ``report`` takes the changed and total stations of each poll, ``late`` the records of late polls.
    """

    path: str
    publish: Callable[[DataFrame, int], None]
    fields: Sequence[str] = TRACKED_FIELDS
    report: Callable[[DataFrame, int], None] | None = None
    late: Callable[[DataFrame, int], None] | None = None

    def process(self, records: DataFrame, batch_id: int) -> None:
        records = records.persist()
        try:
            self._process(records, batch_id)
        finally:
            records.unpersist()

    def _process(self, records: DataFrame, batch_id: int) -> None:
        seen = self._previous(records.sparkSession, batch_id)
        # The polls seen last take part as those before the first one of this batch.
        rows = records.withColumn("_kept", F.lit(False))
        if seen is not None:
            # From the list of polls, which is small: the records are not shuffled by their feed.
            polls = records.sparkSession.read.parquet(self._polls(batch_id - 1))
            newest = polls.groupBy("feed").agg(F.max("ingested_at").alias("_newest"))
            placed = rows.join(newest, "feed", "left")
            if self.late:
                self.late(placed.where("ingested_at < _newest").drop("_kept", "_newest"), batch_id)
            rows = placed.where("_newest is null or ingested_at >= _newest").drop("_newest")
            rows = rows.unionByName(seen.withColumn("_kept", F.lit(True)), allowMissingColumns=True)
        # Written into a slot too, not checkpointed: a standing query must not leave a file behind per batch.
        number_polls(rows).write.mode("overwrite").parquet(self._polls(batch_id))
        flagged = flag_changes(rows, self.fields, polls=records.sparkSession.read.parquet(self._polls(batch_id)))
        flagged = flagged.where("not _kept").drop("_kept", "poll_no")
        self.publish(flagged.where("changed").drop("changed"), batch_id)
        if self.report:
            self.report(poll_counts(flagged), batch_id)
        self._keep(rows, batch_id)

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/stations/slot={batch_id % 2}"

    def _polls(self, batch_id: int) -> str:
        return f"{self.path}/polls/slot={batch_id % 2}"

    def _previous(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        return spark.read.parquet(self._slot(batch_id - 1)) if batch_id else None

    def _keep(self, rows: DataFrame, batch_id: int) -> None:
        narrow = rows.select(*POLL, "pos", "station_id", *self.fields)
        # One row per poll of this batch and the two kept before.
        backwards = W.partitionBy("feed").orderBy(F.desc("ingested_at"))
        polls = narrow.select(*POLL).distinct().withColumn("_back", F.row_number().over(backwards)).where("_back <= 2")
        # An empty poll leaves its row without a station here, so that the next batch knows it took place.
        last = latest(narrow.join(polls, list(POLL), "left_semi"), (*POLL, "station_id"), ("pos",))
        last.write.mode("overwrite").parquet(self._slot(batch_id))


def parquet_publisher(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch's changes under its id, so that a replay replaces them."""

    def publish(changed: DataFrame, batch_id: int) -> None:
        changed.hint("rebalance").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return publish
