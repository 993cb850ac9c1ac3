"""Status joined with station metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.schemas import CURRENT_STATUS


def enrich(status: DataFrame, info: DataFrame, lenient: bool = False) -> DataFrame:
    """Every status row with its station's metadata, in the 20 columns of the current status table.

    Rows without metadata, or without a station, stay with NULLs. The casts are strict unless ``lenient``. No hint is
    given: Spark broadcasts metadata whose known size is small, and AQE splits hot stations of the shuffle join.
    ``status`` may be a stream; ``info`` is then the table as it stands.
    """
    s, i = status.alias("s"), info.alias("i")

    def projected(name: str, side: str, type_: str | None) -> Column:
        value = F.col(("s." if side == "status" else "i.") + name)
        if type_:
            value = value.try_cast(type_) if lenient else value.cast(type_)
        return value.alias(name)

    return s.join(i, F.col("s.station_id") == F.col("i.key"), "left").select(*[projected(*c) for c in CURRENT_STATUS])
