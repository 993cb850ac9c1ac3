"""Bulk and incremental extract of database tables into the staging layer."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.sinks.versions import Versions

# How finely the ranges of a split are cut: a cut is off by at most one part in so many of the rows.
CUT_ACCURACY = 100_000
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


@dataclass(frozen=True)
class Connection:
    """What a JDBC reader needs to reach a database; ``driver`` is its class, if the URL does not tell."""

    url: str
    user: str
    password: str = field(repr=False)
    driver: str | None = None

    def options(self) -> dict[str, str]:
        known = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver}
        return {name: value for name, value in known.items() if value is not None}


@dataclass(frozen=True)
class Split:
    """How to read one table in parallel; without it a JDBC read is a single task."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.partitions),
        }


def jdbc_reader(
    spark: SparkSession, connection: Connection, splits: dict[str, Split | None], fetch_size: int = 10_000
):
    """A reader of tables by name over JDBC (the driver jar must be on the class path).

    Every table is named in ``splits``; None stands for the explicit choice to read a small one in a single task.
    """

    def read(table: str) -> DataFrame:
        if table not in splits:
            raise ValueError(f"name a split for {table}, or None to read it in one task")
        split = splits[table]
        options = {**connection.options(), **(split.options() if split else {}), "dbtable": table, "fetchsize": str(fetch_size)}
        return spark.read.format("jdbc").options(**options).load()

    return read


def _literal(value: str, type_: str) -> str:
    return value if type_.startswith(NUMBERS) else f"'{value}'"


def even_ranges(keys: DataFrame, column: str, partitions: int) -> list[str]:
    """Conditions that part a table into at most so many ranges of ``column`` with about as many rows each.

    ``keys`` are the column's values, whole or a sample that the database draws: numbers, dates or times. The cuts are their
    quantiles, so ranges are narrow where values are dense, and no bounds have to be known. A value that fills several ranges
    by itself gets one, since a condition cannot part it; rows without a value are in a range of their own, if there are any.
    """
    if partitions < 1:
        raise ValueError("at least one partition")
    type_ = keys.schema[column].dataType.simpleString()
    shares = [i / partitions for i in range(1, partitions)]
    cuts = F.array_distinct(F.percentile_approx(column, shares, CUT_ACCURACY)) if shares else F.lit(None)
    found = keys.agg(cuts.cast("array<string>").alias("cuts"), F.count_if(F.col(column).isNull()).alias("empty")).first()
    edges = [_literal(c, type_) for c in found["cuts"] or []]
    # A range ends with its cut, so that a value which is more than one cut fills a range alone.
    ends = [f"{column} <= {e}" for e in edges] + [""]
    begins = [""] + [f"{column} > {e}" for e in edges]
    ranges = [" AND ".join(c for c in pair if c) or f"{column} IS NOT NULL" for pair in zip(begins, ends, strict=True)]
    return ranges + [f"{column} IS NULL"] * bool(found["empty"])


def jdbc_range_reader(
    spark: SparkSession, connection: Connection, ranges: dict[str, Sequence[str]], fetch_size: int = 10_000
):
    """A reader of tables by name over JDBC with one task per condition, those of :func:`even_ranges`."""

    def read(table: str) -> DataFrame:
        if table not in ranges:
            raise ValueError(f"name the ranges of {table}")
        options = {**connection.options(), "fetchsize": str(fetch_size)}
        return spark.read.jdbc(options.pop("url"), table, predicates=list(ranges[table]), properties=options)

    return read


@dataclass(frozen=True)
class Increments:
    """A staged copy of a table that grows: every run copies the rows above the mark that the run before left.

    ``column`` must rise with every row that the source commits, like a serial number, and be filled: a row that turns up at or
    below the mark later is not seen, and one without a value is an error. A run writes a folder and then commits the mark
    together with the folders, so a run that was lost is repeated, and of two at the same time one fails.
    """

    path: str
    column: str

    @property
    def versions(self) -> Versions:
        return Versions(f"{self.path}/versions")

    def run(self, table: DataFrame) -> bool:
        """Copy what is new in ``table``, the source as it stands, whose reader takes filters; False if nothing is."""
        spark, column = table.sparkSession, F.col(self.column)
        number, now = self.versions.newest(spark)
        type_ = table.schema[self.column].dataType.simpleString()
        unseen = table if now is None else table.where((column > F.lit(now["mark"]).cast(type_)) | column.isNull())
        found = unseen.agg(F.max(column).cast("string").alias("mark"), F.count_if(column.isNull()).alias("empty")).first()
        if found["empty"]:
            raise ValueError(f"{found['empty']} rows without {self.column}, which marks what is new")
        if found["mark"] is None:
            return False
        folder = f"rows/run={number + 1}-{uuid.uuid4().hex}"
        # The source may have grown since; what is above the mark is the next run's.
        unseen.where(column <= F.lit(found["mark"]).cast(type_)).write.parquet(f"{self.path}/{folder}")
        folders = [*(now["folders"] if now else []), folder]
        self.versions.commit(spark, number + 1, {"mark": found["mark"], "folders": folders})
        return True

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows that have been copied, with the columns of every run."""
        _, now = self.versions.newest(spark)
        if now is None:
            raise FileNotFoundError(f"nothing has been copied to {self.path}")
        return spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in now["folders"]])


def selected_tables(manifest: DataFrame, connections: Iterable[str]) -> DataFrame:
    """The rows of a manifest (connection, table_name, …) that belong to the named connections."""
    return manifest.where(F.col("connection").isin(*connections))


def load_tables(read: Callable[[str], DataFrame], tables: Iterable[str], write: Callable[[DataFrame, str], None]) -> None:
    """Copy each named table as it is; ``write`` is one of the materializations in :mod:`spokeflow.sinks.tables`."""
    for table in tables:
        write(read(table), table)
