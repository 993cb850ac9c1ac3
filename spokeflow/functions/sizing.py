"""Broadcast only what was counted first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.session import checkpointed

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Compute ``df`` once; broadcast it if its rows and their size as JSON stay within the bounds, else leave a shuffle join."""
    kept = checkpointed(df)
    length = F.octet_length(F.to_json(F.struct("*")))
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    return F.broadcast(kept) if rows <= max_rows and size <= max_bytes else kept


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
