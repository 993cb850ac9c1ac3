"""The operating questions: low stations, peak hours, time-weighted availability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.operators.neighbours import with_previous


def low_availability(current: DataFrame, min_bikes: int = 2, min_ratio: float = 0.1) -> DataFrame:
    """Renting stations with few bikes, in number or against their capacity."""
    bikes = F.col("num_bikes_available")
    ratio = bikes / F.nullif(F.col("capacity"), F.lit(0))
    few = (bikes <= min_bikes) | F.coalesce(ratio <= min_ratio, F.lit(False))
    return current.where((F.col("is_renting") == 1) & few)


def hour_of(ts: Column, zone: str = "UTC") -> Column:
    local = ts if zone == "UTC" else F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return F.hour(local)


def usage_by_hour(
    rows: DataFrame,
    station: str = "station_id",
    value: str = "num_bikes_available",
    order: Sequence[str] = ("ingested_at", "pos"),
    zone: str = "UTC",
) -> DataFrame:
    """Bikes moved per station and hour of day: the sum of absolute steps between a station's successive known values.

    A row without a time comes before all others; its own step has no hour.
    """
    narrow = rows.where(F.col(value).isNotNull()).select(station, *order, value)
    return moved(with_previous(narrow, station, order, [value]), station, value, order[0], zone)


def moved(pairs: DataFrame, station: str, value: str, ts: str, zone: str = "UTC") -> DataFrame:
    """Bikes moved per station and hour of day in rows that know the one before them (:func:`with_previous`)."""
    steps = pairs.where("previous is not null")
    return steps.groupBy(station, hour_of(F.col(ts), zone).alias("hour")).agg(usage_of("previous", value))


def moved_and_held(pairs: DataFrame, station: str, value: str, ts: str, zone: str = "UTC", *others: Column) -> DataFrame:
    """:func:`moved` and :func:`held` in one pass, both per station and hour of day, in rows that also know the one before them
    with a known value. An hour without a step has no ``usage``. ``others`` are aggregated with them."""
    by = [station, hour_of(F.col(ts), zone).alias("hour")]
    return pairs.groupBy(*by).agg(usage_of("previous_known", value), *seconds_of(value, ts), *others)


def usage_of(previous: str, value: str) -> Column:
    return F.sum(F.abs(F.col(value) - F.col(f"{previous}.{value}"))).alias("usage")


def peak_hours(usage: DataFrame, group: str, top: int = 3) -> DataFrame:
    """Busiest hours of each group, ties by hour. At most 24 rows per group are ranked."""
    ranked = W.partitionBy(group).orderBy(F.desc("usage"), "hour")
    return (
        usage.groupBy(group, "hour")
        .agg(F.sum("usage").alias("usage"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
    )


def with_region(usage: DataFrame, info: DataFrame, station: str = "station_id") -> DataFrame:
    """Regions come from the metadata: the current status table does not hold them."""
    regions = info.select(F.col("key").alias(station), "region_id")
    return usage.join(regions, station, "left")


def time_weighted(
    rows: DataFrame,
    station: str = "station_id",
    value: str = "num_bikes_available",
    order: Sequence[str] = ("ingested_at", "pos"),
) -> DataFrame:
    """Mean value per station, each value weighted by the seconds until the station's next row."""
    ts = order[0]
    narrow = rows.select(station, *order, value)
    return mean_over_time(held(with_previous(narrow, station, order, [ts, value]), station, value, ts))


def held(pairs: DataFrame, station: str, value: str, ts: str) -> DataFrame:
    """How long each station held its values, in rows that know the one before them: ``value_seconds`` and ``seconds``."""
    return pairs.groupBy(station).agg(*seconds_of(value, ts))


def seconds_of(value: str, ts: str) -> list[Column]:
    seconds = F.timestamp_diff("SECOND", F.col(f"previous.{ts}"), F.col(ts))
    before = F.col(f"previous.{value}")
    known = F.when(before.isNotNull(), seconds)
    return [F.sum(before * seconds).alias("value_seconds"), F.sum(known).alias("seconds")]


def mean_over_time(sums: DataFrame) -> DataFrame:
    return sums.withColumn("time_weighted", F.col("value_seconds") / F.nullif(F.col("seconds"), F.lit(0)))
