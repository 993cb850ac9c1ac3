"""The change filter for polls that land in any order within a bound.

The records of the polls of the last while are kept between micro-batches, with what was published of each. A late poll takes
its place between its neighbours, and the poll after it is compared again, now with the late one: what is a change by that and
was not published comes out as +I, what was published and is none any more as -D. Whatever the landing order within the bound,
adding up the published changes gives what a filter over all polls in time order gives.

The bound is counted back from the newest poll that earlier micro-batches have brought for the feed. Of the polls beyond it only
the last one is kept, to compare the first one within it. A poll from beyond is set aside, not published.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.operators.changes import POLL, flag_changes, number_polls
from spokeflow.schemas import TRACKED_FIELDS

# Whether a kept record was published; whether its poll only serves to compare the next one; what came out of this micro-batch.
PUBLISHED, ANCHOR, OP = "_published", "_anchor", "op"


@dataclass(frozen=True)
class CorrectingFilter:
    """``process`` is for ``foreachBatch``; ``publish`` takes the changes of a micro-batch with ``op``, ``late`` the records that
    are set aside.

    ``path`` holds two slots used in turn: batch n reads the slot that batch n-1 wrote and replaces the other, so a replayed batch
    gives the same answer. A slot holds the records within the bound and those of one micro-batch.
    """

    path: str
    publish: Callable[[DataFrame, int], None]
    bound: str = "10 minutes"
    fields: Sequence[str] = TRACKED_FIELDS
    late: Callable[[DataFrame, int], None] | None = None

    def process(self, records: DataFrame, batch_id: int) -> None:
        records = records.persist()
        try:
            self._process(records, batch_id)
        finally:
            records.unpersist()

    def _process(self, records: DataFrame, batch_id: int) -> None:
        spark = records.sparkSession
        fresh, kept = records, None
        if batch_id:
            kept, begins = self._history(spark, batch_id - 1)
            placed = records.join(begins, "feed", "left")
            beyond = F.coalesce(F.col("ingested_at") <= F.col("_begins"), F.lit(False))
            if self.late:
                self.late(placed.where(beyond).drop("_begins"), batch_id)
            fresh = placed.where(~beyond).drop("_begins")
        rows = fresh.withColumns({PUBLISHED: F.lit(False), ANCHOR: F.lit(False)})
        if kept is not None:
            rows = rows.unionByName(kept)
        # Written down, not checkpointed: a standing query must not leave a file behind per batch.
        number_polls(rows).write.mode("overwrite").parquet(self._polls(batch_id))
        flagged = flag_changes(rows, self.fields, polls=spark.read.parquet(self._polls(batch_id))).drop("poll_no")
        now = F.when(F.col(ANCHOR), F.col(PUBLISHED)).otherwise(F.col("changed"))
        op = F.when(now & ~F.col(PUBLISHED), "+I").when(~now & F.col(PUBLISHED), "-D")
        judged = flagged.withColumns({OP: op, PUBLISHED: now}).drop("changed")
        # A record without a station is not flagged; it still tells that its poll took place.
        only_told = rows.where("station_id is null").withColumn(OP, F.lit(None).cast("string"))
        judged.unionByName(only_told).write.mode("overwrite").parquet(self._slot(batch_id))
        written = spark.read.parquet(self._slot(batch_id))
        self.publish(written.where(f"{OP} is not null").drop(PUBLISHED, ANCHOR), batch_id)

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/records/slot={batch_id % 2}"

    def _polls(self, batch_id: int) -> str:
        return f"{self.path}/polls/slot={batch_id % 2}"

    def _history(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """The records that a slot leaves to the next micro-batch, and where the bound begins for each feed. That follows from
        the written list of polls, which is small: the records are not shuffled by their feed, of which there may be one."""
        rows = spark.read.parquet(self._slot(batch_id)).drop(OP)
        polls = spark.read.parquet(self._polls(batch_id)).select(*POLL)
        begins = polls.groupBy("feed").agg((F.max("ingested_at") - F.expr(f"interval {self.bound}")).alias("_begins"))
        of_bound = polls.join(begins, "feed")
        last_before = of_bound.where("ingested_at <= _begins").groupBy("feed").agg(F.max("ingested_at").alias("_last"))
        limits = begins.join(last_before, "feed", "left")
        kept = rows.join(limits, "feed").where("ingested_at > _begins or ingested_at = _last")
        return kept.withColumn(ANCHOR, F.col("ingested_at") <= F.col("_begins")).drop("_begins", "_last"), begins
