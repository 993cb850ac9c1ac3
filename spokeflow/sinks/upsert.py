"""A table of the last write per key, or of sums per key, fed by micro-batches.

Each micro-batch writes a folder of its own and then commits a version that names the folders the table consists of. A reader
opens one version and takes the last write per key over the base and the batches that it names. Compaction commits a version
of a new base alone; what only versions before the last base but one name is removed, so the number of folders stays the same
however long the table lives. Cost per batch is that of its changes, not of the table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.operators.upsert import changelog, latest
from spokeflow.sinks.folders import remove_below
from spokeflow.sinks.versions import Versions

BATCH = "_batch"


@dataclass(frozen=True)
class UpsertTable:
    path: str
    key: tuple[str, ...]
    compact_every: int = 50

    @property
    def versions(self) -> Versions:
        return Versions(f"{self.path}/versions")

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch holding at most one row per key. ``foreachBatch`` takes this method as it is.

        Batches come in rising ids. One that is not above the newest was applied before and is left as it is; of two writers
        that apply a batch at the same time one fails with ``VersionTaken``, and finds the batch applied when it comes again.
        Rebalancing keeps a small batch from leaving one small file per state partition.
        """
        spark = rows.sparkSession
        number, now = self.versions.newest(spark)
        if now is None:
            now = {"batch": -1, "folders": [], "base": [0, -1], "base_before": [0, -1]}
        if now["batch"] >= batch_id:
            return
        attempt = f"batch={batch_id}-{uuid.uuid4().hex}"
        numbered = rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        numbered.hint("rebalance").write.parquet(f"{self.path}/log/{attempt}")
        made = {**now, "batch": batch_id, "folders": [*now["folders"], f"log/{attempt}"]}
        compact = self.compact_every and batch_id % self.compact_every == self.compact_every - 1
        if compact:
            base = self._rows(spark, made).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
            base.write.parquet(f"{self.path}/base/{attempt}")
            made.update(folders=[f"base/{attempt}"], base=[number + 1, batch_id], base_before=now["base"])
        self.versions.commit(spark, number + 1, made)
        if compact:
            # Readers of the base before still find it and its log; a reader has one compaction's time.
            version, batch = now["base"]
            remove_below(spark, f"{self.path}/base", batch)
            remove_below(spark, f"{self.path}/log", batch + 1)
            self.versions.remove(spark, max(1, now["base_before"][0]), version)

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The table as of batch ``upto`` (the newest when None); batches before the last base but one are gone."""
        version = self._version(spark, upto)
        if version is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}" + ("" if upto is None else f" as of batch {upto}"))
        return self._rows(spark, version)

    def written(self, spark: SparkSession, upto: int) -> bool:
        """Whether there is a table as of batch ``upto``."""
        return self._version(spark, upto) is not None

    def _version(self, spark: SparkSession, upto: int | None) -> dict | None:
        number, content = self.versions.newest(spark)
        while content is not None and upto is not None and content["batch"] > upto:
            number -= 1
            content = self.versions.read(spark, number)
        return content

    def _rows(self, spark: SparkSession, version: dict) -> DataFrame:
        return self._merged(spark.read.parquet(*[f"{self.path}/{folder}" for folder in version["folders"]]))

    def _merged(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.key, [BATCH]).drop(BATCH)


@dataclass(frozen=True)
class SumTable(UpsertTable):
    """A table of sums per key: a micro-batch writes what it adds to them, and readers add up. The cost of a batch is that of
    the keys it touches; nothing that is there is read.

    ``by`` names columns of the key by which readers go on to join, group or rank: the rows come shuffled by them, which serves
    the sums as well.
    """

    measures: tuple[str, ...] = ()
    by: tuple[str, ...] = ()

    def _merged(self, rows: DataFrame) -> DataFrame:
        if self.by:
            rows = rows.repartition(*self.by)
        return rows.groupBy(*self.key).agg(*[F.sum(m).alias(m) for m in self.measures])


@dataclass(frozen=True)
class ChangelogTable:
    """An upsert table that also writes down what each micro-batch did to it: ``op`` is +I for a row that is new, -U and +U for
    one before and after a change, -D for one that is gone. A row written as it was is no change.

    ``deleted`` names a boolean column that marks deletes; it is part of the table's rows and left out by :meth:`read`.
    """

    table: UpsertTable
    deleted: str | None = None

    @property
    def path(self) -> str:
        return f"{self.table.path}/changes"

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch holding at most one row per key. The changes are written first and follow from the table as of
        the batch before, so a replay writes the same."""
        rows = rows.persist()
        try:
            spark = rows.sparkSession
            known = self.table.written(spark, batch_id - 1)
            before = self.table.read(spark, batch_id - 1) if known else spark.createDataFrame([], rows.schema)
            changes = changelog(before, rows, self.table.key, self.deleted)
            changes.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
            self.table.write_batch(rows, batch_id)
        finally:
            rows.unpersist()

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        rows = self.table.read(spark, upto)
        return rows.where(~F.coalesce(F.col(self.deleted), F.lit(False))).drop(self.deleted) if self.deleted else rows

    def changes(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The changes of all batches, or of those up to one, with their ``batch``."""
        rows = spark.read.parquet(self.path)
        return rows if upto is None else rows.where(F.col("batch") <= upto)

