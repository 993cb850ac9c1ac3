"""A row and the row before it, per key, in one form for every size: no counting first, and no window over a whole key (unless
its caller knows that the keys are small)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeflow.functions.sizing import micros

HOUR_MICROS = 3_600 * 1_000_000
# Rows of one instant, by the second order column, that one task sorts at most for a key.
RUN = 100_000
# Groups per key, or cell of it, in which rows pass by that need no other row any more.
ASIDE = 1_024
UNORDERED = (T.MapType, T.VariantType)


def with_previous(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    carry: Sequence[str],
    cell: int | None = HOUR_MICROS,
    run: int = RUN,
    known: str | None = None,
) -> DataFrame:
    """Add ``previous``: the ``carry`` columns of the key's row just before, by ``order`` (time first); NULL for the first.

    With ``known``, also add ``previous_known``: the same columns of the last row before in which the column ``known`` is not
    NULL, for rows in which it is not NULL itself; and ``is_last`` and ``last_known``: whether no row of the key comes after
    this one, and for such a row the same columns of the key's last known row, which may be itself.

    Rows without a time come first. Equal rows by ``order`` go by the other columns. The answer does not depend on ``cell``
    and ``run``; they only say how a key is cut: into cells of time (microseconds), and a cell into its instants, of which a
    hot one is cut by the second order column. A window inside each piece finds most rows; the rows that a piece leaves open
    find theirs among those at the ends of the cell's pieces, and what a cell leaves open among the ends of the key's cells.
    Rows that are done pass by in small groups, so that each window is computed once, over all rows.

    ``cell=None`` does not cut: one window over each key, by which the rows are shuffled and sorted once, for keys that a task can
    sort.
    """
    ts, *rest = order
    others = [f.name for f in df.schema if f.name not in (key, *order) and not isinstance(f.dataType, UNORDERED)]
    full = [*order, *others]
    row = F.struct(*carry)
    own = F.when(F.col(known).isNotNull(), row) if known else None
    columns = [*df.columns, "previous", *(["previous_known", "is_last", "last_known"] if known else [])]
    if cell is None:
        whole = W.partitionBy(key).orderBy(*full)
        rows = df.withColumn("previous", F.lag(row).over(whole))
        if known:
            rows = rows.withColumns(
                {"is_last": F.lead(F.lit(True)).over(whole).isNull(), "_before": F.last(own, ignorenulls=True).over(_until(whole))}
            ).withColumns(_known_columns(own, F.col("_before"), F.coalesce(own, "_before")))
        return rows.select(*columns)
    piece = W.partitionBy(key, "_cell", ts, "_run").orderBy(*full)
    rows = df.withColumns(
        {
            "_cell": F.floor(micros(F.col(ts)) / F.lit(cell)).cast("bigint"),
            "_run": F.floor(F.col(rest[0]) / F.lit(run)).cast("bigint") if rest else F.lit(0),
        }
    ).withColumns(
        {
            "previous": F.lag(row).over(piece),
            "_n": F.row_number().over(piece),
            "_opens": F.lag(F.lit(True)).over(piece).isNull(),
            "_closes": F.lead(F.lit(True)).over(piece).isNull(),
        }
    )
    at_end = F.col("_opens") | F.col("_closes")
    if known:
        # ``_known``: the last known row up to this one; ``_lacks``: a known row that has found none before it yet.
        before = F.last(own, ignorenulls=True).over(_until(piece))
        rows = rows.withColumn("_before", before).withColumns(
            {
                "previous_known": F.when(own.isNotNull(), F.col("_before")),
                "_known": F.coalesce(own, "_before"),
                "_lacks": own.isNotNull() & F.col("_before").isNull(),
            }
        )
        at_end |= F.col("_lacks")
    for scope in ([key, "_cell"], [key]):
        aside = F.when(~at_end, F.pmod(F.xxhash64(*order, "_n"), F.lit(ASIDE)))
        rows = rows.withColumn("_aside", aside)
        ends = W.partitionBy(*scope, "_aside").orderBy(*full, "_n")
        found = {
            "_found": F.lag(row).over(ends),
            "_first": F.lag(F.lit(True)).over(ends).isNull(),
            "_last": F.lead(F.lit(True)).over(ends).isNull(),
        }
        if known:
            found["_before"] = F.last("_known", ignorenulls=True).over(_until(ends))
        rows = rows.withColumns(found)
        filled = {
            "previous": F.when(F.col("_opens"), F.col("_found")).otherwise(F.col("previous")),
            "_opens": F.col("_opens") & F.col("_first"),
            "_closes": F.col("_closes") & F.col("_last"),
        }
        if known:
            filled |= {
                "previous_known": F.when(F.col("_lacks"), F.col("_before")).otherwise(F.col("previous_known")),
                "_known": F.coalesce("_known", "_before"),
                "_lacks": F.col("_lacks") & F.col("_before").isNull(),
            }
        rows = rows.withColumns(filled)
    if known:
        rows = rows.withColumn("is_last", F.col("_closes")).withColumns(
            _known_columns(own, F.col("previous_known"), F.col("_known"))
        )
    return rows.select(*columns)


def _known_columns(own: Column, before: Column, upto: Column) -> dict[str, Column]:
    return {"previous_known": F.when(own.isNotNull(), before), "last_known": F.when(F.col("is_last"), upto)}


def _until(window: WindowSpec) -> WindowSpec:
    """All rows before a row."""
    return window.rowsBetween(W.unboundedPreceding, -1)
