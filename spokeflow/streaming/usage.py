"""Usage and time-weighted availability as standing answers, brought up to date by what each micro-batch adds.

A step between two rows counts once, wherever micro-batches are cut: the last row of every station, and its last one with a
known value, are carried into the next micro-batch and stand before its rows. Sums per station and hour, and per station, are
tables of differences; the busiest hours are ranked anew for the stations of the micro-batch only.

Rows of a station are expected in order. One that does not stand after the last row of its station that was counted in an earlier
micro-batch is late: it is set aside, not counted, since the step it would part is in the sums already. Rows without a station
belong to the rejects.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.operators.analytics import moved_and_held, peak_hours
from spokeflow.operators.neighbours import with_previous
from spokeflow.sinks.upsert import SumTable, UpsertTable


@dataclass(frozen=True)
class LiveUsage:
    """``process`` is for ``foreachBatch``; ``hours`` (usage per station and hour), ``times`` (seconds held per station) and
    ``peaks`` (busiest hours per station) are the tables it keeps under ``path``.

    ``path`` also holds two slots of last rows, and of what a batch adds, used in turn: batch n reads the slot that batch n-1 wrote and replaces the other,
    so a replayed batch gives the same answers. ``late`` takes the rows that are set aside.
    """

    path: str
    station: str = "station_id"
    value: str = "num_bikes_available"
    order: Sequence[str] = ("ingested_at", "pos")
    zone: str = "UTC"
    top: int = 3
    late: Callable[[DataFrame, int], None] | None = None
    # Rows of a station in one micro-batch that one task sorts at most.
    whole: int = 1_000_000

    @property
    def hours(self) -> SumTable:
        return SumTable(f"{self.path}/hours", (self.station, "hour"), measures=("usage",), by=(self.station,))

    @property
    def times(self) -> SumTable:
        return SumTable(f"{self.path}/times", (self.station,), measures=("value_seconds", "seconds"))

    @property
    def peaks(self) -> UpsertTable:
        return UpsertTable(f"{self.path}/peaks", (self.station, "rank"))

    def process(self, rows: DataFrame, batch_id: int) -> None:
        rows = rows.where(F.col(self.station).isNotNull()).select(self.station, *self.order, self.value).persist()
        try:
            self._process(rows, batch_id)
        finally:
            rows.unpersist()

    def _process(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        both = rows.withColumn("_carried", F.lit(False))
        if batch_id:
            both = both.unionByName(spark.read.parquet(self._slot(batch_id - 1)).withColumn("_carried", F.lit(True)))
        hot = self._hot(rows)
        # The windows over the rows are computed once; all tables, and the last rows, are fed from what they add.
        added = f"{self.path}/added/slot={batch_id % 2}"
        self._added(self._pairs(both, hot)).write.mode("overwrite").parquet(added)
        if self.late and batch_id:
            placed, cut = self._split(both, hot)
            late = (placed.unionByName(cut) if hot else placed).where("_late")
            self.late(late.select(rows.columns), batch_id)
        added = spark.read.parquet(added)
        fresh = added.where("not _only_carried")
        self.hours.write_batch(fresh.where("usage is not null").select(self.station, "hour", "usage"), batch_id)
        sums = [F.sum(m).alias(m) for m in self.times.measures]
        self.times.write_batch(fresh.groupBy(self.station).agg(*sums), batch_id)
        # Hours are only added, so a station never has fewer ranks than before.
        stations = fresh.select(self.station).distinct()
        hours = self.hours.read(spark, batch_id).join(stations, self.station, "left_semi")
        self.peaks.write_batch(peak_hours(hours, self.station, self.top), batch_id)
        self._keep(added, batch_id)

    def _hot(self, rows: DataFrame) -> list:
        """Stations with more rows than one task should sort: at most one for each ``whole`` rows of the micro-batch."""
        return [r[0] for r in rows.groupBy(self.station).count().where(F.col("count") > self.whole).collect()]

    def _split(self, both: DataFrame, hot: Sequence) -> tuple[DataFrame, DataFrame | None]:
        """Rows of stations that a task can sort, and rows of hot ones if there are any, both with ``_late``: whether they stand
        at or before the last row carried for their station. The former come shuffled and sorted as :meth:`_pairs` needs them."""
        before = F.when(F.col("_carried"), self._at())
        late = ~F.col("_carried") & F.coalesce(self._at() <= F.col("_last"), F.lit(False))
        whole = W.partitionBy(self.station).orderBy(*self.order, self.value, "_carried")
        whole = whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        ours = F.col(self.station).isin(list(hot))
        others = both.where(~ours) if hot else both
        placed = others.repartition(self.station).withColumn("_last", F.max(before).over(whole))
        if not hot:
            return placed.withColumn("_late", late).drop("_last"), None
        cut = both.where(ours)
        last = cut.where("_carried").groupBy(self.station).agg(F.max(self._at()).alias("_last"))
        cut = cut.join(F.broadcast(last), self.station, "left")
        return tuple(df.withColumn("_late", late).drop("_last") for df in (placed, cut))

    def _pairs(self, both: DataFrame, hot: Sequence) -> DataFrame:
        """Rows that are not late with the ones before them. Only hot stations are cut, with a shuffle for each cut; the rows of all
        others are shuffled once."""
        placed, cut = self._split(both, hot)
        carry = [*self.order, self.value]
        counted = lambda df: df.where("not _late").drop("_late")
        pairs = with_previous(counted(placed), self.station, self.order, carry, None, known=self.value)
        return pairs.unionByName(with_previous(counted(cut), self.station, self.order, carry, known=self.value)) if hot else pairs

    def _added(self, pairs: DataFrame) -> DataFrame:
        """What rows add per station and hour, and on the row of a station's last hour its last row (``_any_*``) and its last one
        with a known value (``_known_*``). Carried rows add nothing."""
        fresh = ~F.col("_carried")
        counted = pairs.withColumns({p: F.when(fresh, F.col(p)) for p in ("previous", "previous_known")})
        last = [F.max(F.when(F.col("is_last"), F.col(c))).alias(f"_any_{c}") for c in (*self.order, self.value)]
        last += [F.max(f"last_known.{c}").alias(f"_known_{c}") for c in (*self.order, self.value)]
        flags = [F.min("_carried").alias("_only_carried"), F.max("is_last").alias("_closes")]
        return moved_and_held(counted, self.station, self.value, self.order[0], self.zone, *flags, *last)

    def _at(self) -> Column:
        """Where a row stands among those of its station; one without a time stands before all others."""
        return F.struct(*self.order)

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/last/slot={batch_id % 2}"

    def _keep(self, added: DataFrame, batch_id: int) -> None:
        def row(of: str) -> Column:
            return F.struct(*[F.col(f"_{of}_{c}").alias(c) for c in (*self.order, self.value)])

        known = F.when(F.col(f"_known_{self.value}").isNotNull(), row("known"))
        kept = F.array_distinct(F.filter(F.array(row("any"), known), lambda r: r.isNotNull()))
        last = added.where("_closes").select(self.station, F.inline(kept))
        last.hint("rebalance").write.mode("overwrite").parquet(self._slot(batch_id))
