"""Last write per key, and what a set of writes changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(
    rows: DataFrame, key: str | Sequence[str], version: Sequence[str], deleted: Column | None = None
) -> DataFrame:
    """The row with the highest version of each key; keys whose last row is a delete vanish.

    One aggregation, combined before the shuffle, so a hot key sends one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kept = (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct("*"), F.struct(*version)).alias("_row"))
        .select("_row.*")
    )
    return kept if deleted is None else kept.where(~F.coalesce(deleted, F.lit(False)))


def changelog(before: DataFrame, rows: DataFrame, key: Sequence[str], deleted: str | None = None) -> DataFrame:
    """What writing ``rows`` (at most one per key) does to the table ``before``: its rows with ``op`` +I, -U, +U or -D.

    Rows are compared as a whole, NULLs being equal; one that stays as it is gives nothing. ``deleted`` names a boolean column
    of both; a row marked there is not in the table. Only touched keys of ``before`` are compared: the join is an outer one from
    ``rows``, whose hot side adaptive execution can split.
    """
    columns = [c for c in rows.columns if c != deleted]

    def row(df: DataFrame, name: str) -> DataFrame:
        there = F.lit(True) if deleted is None else ~F.coalesce(F.col(deleted), F.lit(False))
        keys = [F.col(k).alias(f"_{name}_{i}") for i, k in enumerate(key)]
        return df.select(*keys, F.when(there, F.struct(*columns)).alias(f"_{name}"))

    same = F.lit(True)
    for i in range(len(key)):
        same = same & F.col(f"_new_{i}").eqNullSafe(F.col(f"_old_{i}"))
    met = row(rows, "new").join(row(before.select(rows.columns), "old"), same, "left")
    old, new = F.col("_old"), F.col("_new")
    entry = lambda op, row: F.struct(F.lit(op).alias("op"), row.alias("row"))
    entries = (
        F.when(old.isNull() & new.isNotNull(), F.array(entry("+I", new)))
        .when(old.isNotNull() & new.isNull(), F.array(entry("-D", old)))
        .when(~old.eqNullSafe(new), F.array(entry("-U", old), entry("+U", new)))
    )
    return met.select(F.inline(entries)).select("op", "row.*")


def folded(changes: DataFrame) -> DataFrame:
    """The table that a changelog leads to: rows that came more often than they went."""
    columns = [c for c in changes.columns if c not in ("op", "batch")]
    step = F.when(F.col("op").isin("+I", "+U"), 1).otherwise(-1)
    return changes.groupBy(*columns).agg(F.sum(step).alias("_n")).where("_n > 0").drop("_n")
