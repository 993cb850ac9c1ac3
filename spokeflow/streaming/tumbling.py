"""Tumbling windows as a standing query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from spokeflow.operators.windows import FIVE_MINUTES, tumbling

WATERMARK = "10 minutes"


def tumbling_stream(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    order: Sequence[str],
    interval: str = FIVE_MINUTES,
    watermark: str = WATERMARK,
) -> DataFrame:
    """The batch windows over a stream. A late row still counts while its window is open; the watermark bounds state.

    Use update mode to see open windows, append mode to see each window once, when it has closed.
    """
    return tumbling(rows.withWatermark(ts, watermark), keys, ts, value, order, interval)
