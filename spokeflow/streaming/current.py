"""The current status table: a left join that is updated from both sides.

A new status and a new, changed or deleted metadata row each re-emit the joined row of their station. A stream-stream join
would keep every row of both sides; here both logs are one stream of keyed changes, and one aggregation keeps the newest row of
either side per station, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeflow.functions.sizing import micros
from spokeflow.schemas import CURRENT_STATUS
from spokeflow.sources.topics import log_position


def _columns(side: str) -> list[str]:
    return [name for name, of, _ in CURRENT_STATUS if of == side]


def _version(columns: Sequence[Column]) -> Column:
    """A version of whole numbers; an unknown part counts as the oldest."""
    return F.struct(*[F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"v{i}") for i, c in enumerate(columns)])


def _side(rows: DataFrame, key: str, version: Column, row: Column, kind: str, types: dict[str, T.StructType]) -> DataFrame:
    """One side's rows as changes with both sides' columns; the other side's are NULL."""
    columns = []
    for side, type_ in types.items():
        own = side == kind
        # A wrapped row: a delete is a newest entry without a row, so that older metadata does not come back.
        columns.append((F.struct(row.alias("row")) if own else F.lit(None).cast(T.StructType().add("row", type_))).alias(side))
        columns.append((version if own else F.lit(None).cast("struct<v0:bigint,v1:bigint>")).alias(f"{side}_version"))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("station_id"), *columns)


def current_status(status: DataFrame, info: DataFrame) -> DataFrame:
    """Changelog of the current status table, at most one row per station and micro-batch, keyed by ``station_id``.

    ``status`` has the status columns, ``ingested_at`` as version and ``pos`` to break its ties; a row without a time counts
    as the oldest. ``info`` has the metadata columns, ``key`` and ``deleted``; its order is that of its log
    (:func:`log_position`), or of ``_ingested_at`` where the rows have no position. Rows without a station belong to the
    rejects.
    """
    s_columns, i_columns = _columns("status"), _columns("info")
    types = {
        "status": T.StructType([T.StructField(c, status.schema[c].dataType) for c in s_columns]),
        "info": T.StructType([T.StructField(c, info.schema[c].dataType) for c in i_columns]),
    }
    position = log_position(info.columns)
    i_version = [F.col(c) for c in position] if position else [micros(F.col("_ingested_at"))]
    i_row = F.when(~F.coalesce("deleted", F.lit(False)), F.struct(*i_columns))
    s_version = _version([micros(F.col("ingested_at")), F.col("pos")])
    changes = _side(status, "station_id", s_version, F.struct(*s_columns), "status", types).unionByName(
        _side(info, "key", _version([*i_version, F.lit(0)][:2]), i_row, "info", types)
    )
    newest = changes.groupBy("station_id").agg(
        *[F.max_by(side, f"{side}_version").alias(side) for side in types]
    )
    return newest.where("status is not null").select(
        *[
            (F.col(f"{side}.row.{name}").cast(t) if t else F.col(f"{side}.row.{name}")).alias(name)
            for name, side, t in CURRENT_STATUS
        ]
    )
