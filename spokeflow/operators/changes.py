"""Keep only the stations whose tracked state differs from the previous poll."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.schemas import TRACKED_FIELDS

POLL = ("feed", "ingested_at")


def state(fields: Sequence[str] = TRACKED_FIELDS, prefix: str = "") -> Column:
    """The tracked fields as one comparable value; an absent field is NULL."""
    return F.struct(*[F.col(prefix + name).alias(name) for name in sorted(fields)])


def number_polls(rows: DataFrame) -> DataFrame:
    """The successful polls of each feed, numbered in time order. Small: one row per poll, not per station."""
    order = W.partitionBy("feed").orderBy("ingested_at")
    return rows.select(*POLL).distinct().withColumn("poll_no", F.row_number().over(order))


def last_states(numbered: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each station's state at the end of each poll (its last record there), prefixed ``last_``."""
    return numbered.groupBy("feed", "poll_no", "station_id").agg(
        *[F.max_by(name, "pos").alias(f"last_{name}") for name in fields]
    )


def flag_changes(
    rows: DataFrame, fields: Sequence[str] = TRACKED_FIELDS, polls: DataFrame | None = None
) -> DataFrame:
    """Add ``changed`` to exploded status records (feed, ingested_at, pos, station_id, the fields, …).

    A record changed when its station was not in the previous poll of the feed or ended that poll in another state.
    Records without a station only tell that their poll took place (an empty poll, or one of rejects); they are not
    returned. ``polls`` is the numbered list of polls, if it is at hand as a table. Nothing is computed here; stage rows that
    are costly to decode before (:func:`spokeflow.plans.stations.status_log`).
    """
    if polls is None:
        polls = number_polls(rows)
    numbered = rows.join(polls, list(POLL)).where("station_id is not null")
    # Keyed by the poll that is compared with it. The shift makes both join sides plain shuffles, which AQE can split
    # when one (poll, station) is hot.
    before = last_states(numbered, fields).withColumn("poll_no", F.col("poll_no") + 1).withColumn("_seen", F.lit(True))
    return (
        numbered.join(before, ["feed", "poll_no", "station_id"], "left")
        .withColumn("changed", F.col("_seen").isNull() | ~state(fields).eqNullSafe(state(fields, "last_")))
        .drop("_seen", *[f"last_{name}" for name in fields])
    )


def changed(rows: DataFrame, fields: Sequence[str] = TRACKED_FIELDS) -> DataFrame:
    """Only the records worth publishing."""
    return flag_changes(rows, fields).where("changed").drop("changed", "poll_no")


def poll_counts(flagged: DataFrame) -> DataFrame:
    """Changed and total stations of each poll."""
    return flagged.groupBy(*POLL).agg(F.count_if("changed").alias("changed"), F.count("*").alias("total"))
