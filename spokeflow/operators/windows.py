"""Tumbling windows over a change-only status stream.

A station sends a row only when something changed, so a window without a row means "as before", not "no data".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.session import checkpointed

FIVE_MINUTES = "5 minutes"
# Windows whose running sum one task computes.
BLOCK = 1_000


def in_windows(rows: DataFrame, keys: Sequence[str], ts: str, interval: str, measures: Sequence[Column]) -> DataFrame:
    """Aggregate per key and window; grouping by the window itself lets a stream's watermark close it."""
    return (
        rows.groupBy(*keys, F.window(ts, interval).alias("window"))
        .agg(*measures)
        .withColumn("window", F.col("window.start"))
        .withColumnRenamed("window", "window_start")
    )


def tumbling(
    rows: DataFrame, keys: Sequence[str], ts: str, value: str, order: Sequence[str], interval: str = FIVE_MINUTES
) -> DataFrame:
    """Count, extremes, mean, first and last value and net change of each key's rows in each window.

    With a time column alone as ``order``, for rows that have no ties, the aggregation needs no sort.
    """
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    measures = [
        F.count("*").alias("n"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("avg_value"),
        F.min_by(value, at).alias("first_value"),
        F.max_by(value, at).alias("last_value"),
    ]
    windows = in_windows(rows, keys, ts, interval, measures)
    return windows.withColumn("change", F.col("last_value") - F.col("first_value"))


def change_since_previous(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the change against the key's previous window that had rows. Sorts windows, never raw rows."""
    order = W.partitionBy(*keys).orderBy("window_start")
    return windows.withColumn("change_since_previous", F.col("last_value") - F.lag("last_value").over(order))


def last_values(
    rows: DataFrame, keys: Sequence[str], ts: str, value: str, order: Sequence[str], interval: str = FIVE_MINUTES
) -> DataFrame:
    """Each key's last known value in each window that has one."""
    known = rows.where(F.col(value).isNotNull())
    return in_windows(known, keys, ts, interval, [F.max_by(value, F.struct(*order)).alias("value")])


def fill_forward(windows: DataFrame, keys: Sequence[str], interval: str = FIVE_MINUTES) -> DataFrame:
    """Repeat each window's ``value`` up to the key's next window, so that every window in between has a row."""
    step = F.expr(f"interval {interval}")
    following = F.lead("window_start").over(W.partitionBy(*keys).orderBy("window_start"))
    until = F.coalesce(following - step, F.col("window_start"))
    return windows.withColumn("_until", until).select(
        *keys, F.explode(F.sequence("window_start", "_until", step)).alias("window_start"), "value"
    )


def area_totals(
    windows: DataFrame, station: str, area: Sequence[str] = (), interval: str = FIVE_MINUTES, block: int = BLOCK
) -> DataFrame:
    """Sum over stations of the value each one last had, for every window up to the last one of all.

    Summing the stations' changes per window and running that sum over the windows gives the same totals as filling
    every station's gaps, without a row per station and window. The sums run within blocks of ``block`` windows; what a
    block begins with is the running sum over the blocks before it, one row per area and block. The rows per window are kept
    in the shared folder, so that the end of all windows does not cost another pass over the rows.
    """
    own = W.partitionBy(station, *area).orderBy("window_start")
    moved = F.col("value") - F.coalesce(F.lag("value").over(own), F.lit(0))
    per_window = windows.withColumn("moved", moved).groupBy(*area, "window_start").agg(F.sum("moved").alias("moved"))
    return running_totals(per_window, area, interval, block)


def running_totals(per_window: DataFrame, area: Sequence[str] = (), interval: str = FIVE_MINUTES, block: int = BLOCK) -> DataFrame:
    """The totals of :func:`area_totals` from how much each area ``moved`` in each window that had a row."""
    step = F.expr(f"interval {interval}")
    per_window = checkpointed(per_window.withColumnRenamed("moved", "_moved"))
    end = per_window.agg(F.max("window_start")).scalar()
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    length = F.unix_micros((epoch + step).cast("timestamp")) * block
    cut = per_window.withColumn("_block", F.floor(F.unix_micros(F.col("window_start").cast("timestamp")) / length))
    over_blocks = W.partitionBy(*area).orderBy("_block")
    blocks = (
        cut.groupBy(*area, "_block")
        .agg(F.sum("_moved").alias("_all"), F.min("window_start").alias("_first"))
        .select(
            *[F.col(a).alias(f"_of_{a}") for a in area],
            F.col("_block").alias("_at"),
            F.coalesce(F.sum("_all").over(over_blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            (F.lead("_first").over(over_blocks) - step).alias("_next"),
        )
    )
    match = F.col("_block") == F.col("_at")
    for a in area:
        match &= F.col(a).eqNullSafe(F.col(f"_of_{a}"))
    inside = W.partitionBy(*area, "_block").orderBy("window_start")
    totals = cut.join(blocks, match).select(
        *area,
        "window_start",
        (F.col("_before") + F.sum("_moved").over(inside)).alias("total"),
        F.coalesce(F.lead("window_start").over(inside) - step, "_next", end).alias("_until"),
    )
    return totals.select(*area, F.explode(F.sequence("window_start", "_until", step)).alias("window_start"), "total")
