"""Area totals as a standing query: each station's last value in each window, carried into the windows without a row.

Per station, the stream's state holds the last row of every window that is still open, and the value that the closed windows
ended with. A window closes when the watermark passes its end, by the station's next row or by an event-time timer: it leaves the
state, and its value is what later windows start from. What goes out are differences: a row that changes the last value of a window changes how much the station moved in that
window and, the other way round, in its next one. Added up per area and window they are the ``moved`` of
:func:`spokeflow.operators.windows.running_totals`, which carries totals into the windows in which nothing moved. So a total
is right after every micro-batch, in whatever order rows came within the watermark, and no row is made per station and window.

A row of a window that is closed comes too late: it is left out and counted (``late``). Rows later than the watermark of the
micro-batch before are dropped by Spark itself and counted in the query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spokeflow.functions.sizing import micros
from spokeflow.operators.windows import FIVE_MINUTES, running_totals
from spokeflow.sinks.upsert import SumTable
from spokeflow.streaming.tumbling import WATERMARK

# A station's state: the value that its closed windows ended with, and the last row of each open window, as lists of equal length.
STATE = "closed bigint, starts array<bigint>, ats array<bigint>, places array<bigint>, held array<bigint>"


class StationWindows(StatefulProcessor):
    """Keyed by (area columns, station): rows of ``at`` and ``start`` (microseconds), ``pos``, ``value`` to differences.

    A station's state is read and written once a micro-batch, and one timer, at the end of its last open window, closes them all.
    """

    def __init__(self, columns: Sequence[str], width: int):
        self.columns, self.width = list(columns), width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", STATE)

    def _moved(self, windows: dict[int, tuple[int, int, int]], base: int) -> dict[int, int]:
        """How much the station moved in each open window that has a row."""
        out, value = {}, base
        for start in sorted(windows):
            out[start], value = windows[start][2] - value, windows[start][2]
        return out

    def _read(self) -> tuple[dict[int, tuple[int, int, int]], int]:
        if not self.state.exists():
            return {}, 0
        closed, starts, *rows = self.state.get()
        return dict(zip(starts, zip(*rows, strict=True), strict=True)), closed

    def _write(self, windows: dict[int, tuple[int, int, int]], base: int, over: int) -> None:
        """Close what ended by ``over``, and keep the rest."""
        ended = sorted(start for start in windows if start + self.width <= over)
        if ended:
            base = windows[ended[-1]][2]
        kept = sorted(windows.keys() - set(ended))
        rows = zip(*[windows[start] for start in kept], strict=True) if kept else ([], [], [])
        self.state.update((base, kept, *map(list, rows)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        windows, base = self._read()
        over = timerValues.getCurrentWatermarkInMs() * 1_000
        before, late = self._moved(windows, base), Counter()
        for part in rows:
            for start, *row in zip(*[part[c].tolist() for c in ("start", "at", "pos", "value")], strict=True):
                if start + self.width <= over:
                    late[start] += 1
                # Only the last row of a window counts.
                elif start not in windows or tuple(row[:2]) >= windows[start][:2]:
                    windows[start] = tuple(row)
        after = self._moved(windows, base)
        # A window that had no row until now is told of even if nothing moved in it.
        moved = {s: m - before.get(s, 0) for s, m in after.items() if s not in before or m != before[s]}
        if windows:
            self._write(windows, base, over)
            self.handle.registerTimer((max(windows) + self.width) // 1_000)
        out = [[*key, s, m, 0] for s, m in sorted(moved.items())] + [[*key, s, 0, n] for s, n in sorted(late.items())]
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows, base = self._read()
        self._write(windows, base, expiredTimerInfo.getExpiryTimeInMs() * 1_000)
        return iter(())


def moved_stream(
    rows: DataFrame, station: str, ts: str, value: str, pos: str, area: Sequence[str] = (), interval: str = FIVE_MINUTES, watermark: str = WATERMARK
) -> DataFrame:
    """Differences of ``moved`` per station, area and ``window_start``, for a sink that adds them up (update mode); rows with
    ``late`` only tell how many rows of a window came too late.

    ``ts`` must be a timestamp. Rows without a time or value tell nothing here; a station belongs to one area.
    """
    # Workers need not have the package installed to run this module.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    width = int(pd.Timedelta(interval) / pd.Timedelta("1us"))
    known = rows.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withWatermark(ts, watermark)
    at = micros(F.col(ts))
    narrow = known.select(
        *area, station, ts, at.alias("at"), (at - F.pmod(at, F.lit(width))).alias("start"),
        F.col(pos).cast("bigint").alias("pos"), F.col(value).cast("bigint").alias("value"),
    )
    columns = [*area, station, "start", "moved", "late"]
    schema = T.StructType([rows.schema[c] for c in (*area, station)]).add("start", "long").add("moved", "long").add("late", "long")
    found = narrow.groupBy(*area, station).transformWithStateInPandas(StationWindows(columns, width), schema, "Update", "EventTime")
    return found.withColumn("window_start", F.timestamp_micros("start")).drop("start")


@dataclass(frozen=True)
class AreaTotals:
    """What the differences add up to, per area and window. ``write_batch`` is for ``foreachBatch`` in update mode."""

    path: str
    area: tuple[str, ...] = ()
    interval: str = FIVE_MINUTES

    def _table(self, measure: str) -> SumTable:
        return SumTable(f"{self.path}/{measure}", (*self.area, "window_start"), measures=(measure,))

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            for measure, wanted in (("moved", rows.where("late = 0")), ("late", rows.where("late > 0"))):
                added = wanted.groupBy(*self.area, "window_start").agg(F.sum(measure).alias(measure))
                self._table(measure).write_batch(added, batch_id)
        finally:
            rows.unpersist()

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """``window_start`` and ``total`` of every area, up to the last window of all."""
        return running_totals(self._table("moved").read(spark, upto), self.area, self.interval)

    def late(self, spark: SparkSession) -> DataFrame:
        """How many rows of each window came after it was closed."""
        return self._table("late").read(spark)
