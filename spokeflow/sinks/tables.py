"""Tables and views in layered namespaces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spokeflow.sinks.folders import finished, remove_below


@dataclass(frozen=True)
class Layers:
    """Databases of the two layers, and the folder their tables live in (the warehouse when None)."""

    staging: str = "staging"
    marts: str = "marts"
    location: str | None = None

    def create(self, spark: SparkSession) -> None:
        for name in (self.staging, self.marts):
            where = f" LOCATION '{self.location}/{name}'" if self.location else ""
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{where}")


def asset_name(prefix: str, table: str) -> str:
    """Fixed prefix, then the upper-cased table name."""
    return f"{prefix}_{table.upper()}"


def write_table(df: DataFrame, name: str) -> None:
    """Replace a managed table."""
    df.write.mode("overwrite").saveAsTable(name)


def replace_table(df: DataFrame, name: str, check: Callable[[DataFrame], None] | None = None) -> None:
    """Write a table's next version aside, let ``check`` look at what was written, then point the table at it.

    Readers see the old rows or the new ones, whole; ``df`` may read the table itself. If the write fails or ``check`` raises,
    the table stays as it was. The version before is kept for readers that have begun. The swap is one change of the table's
    location, or, where columns differ, the table's entry is dropped and made anew. One writer per table at a time: of two, the
    later finds the folder of its version taken and fails.
    """
    spark = df.sparkSession
    database, _, short = name.rpartition(".")
    location = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    root = f"{location.rstrip('/')}/{short}.versions"
    number = max(finished(spark, root), default=-1) + 1
    folder = f"{root}/batch={number}"
    df.write.parquet(folder)
    rows = spark.read.parquet(folder)
    if check is not None:
        check(rows)
    known = spark.catalog.tableExists(name)
    live = _live_version(spark, name, root) if known else None
    if live is not None and spark.table(name).schema == rows.schema:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
    else:
        if known:
            spark.sql(f"DROP TABLE {name}")
        spark.catalog.createTable(name, path=folder, source="parquet", schema=rows.schema)
    if live is not None:
        remove_below(spark, root, live)


def _live_version(spark: SparkSession, name: str, root: str) -> int | None:
    """The version that a table points at; None if it is not one of ``root``."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    parent, _, number = (described.data_type if described else "").rpartition("/batch=")
    return int(number) if number.isdigit() and parent.endswith(root.rsplit("/", 1)[1]) else None


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def write_path(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
