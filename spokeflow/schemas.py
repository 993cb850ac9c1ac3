"""Columns at each boundary."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields whose change makes a station's status worth publishing.
TRACKED_FIELDS = (
    "num_bikes_available",
    "num_ebikes_available",
    "num_bikes_disabled",
    "num_docks_available",
    "num_docks_disabled",
    "is_installed",
    "is_renting",
    "is_returning",
)

# Status fields read downstream though they never trigger an event, so they can be stale there.
CARRIED_FIELDS = {
    "num_scooters_available": "int",
    "num_scooters_unavailable": "int",
    "last_reported": "bigint",
    "eightd_has_available_keys": "boolean",
    "legacy_id": "string",
}

STATUS_FIELDS = {**dict.fromkeys(TRACKED_FIELDS, "int"), **CARRIED_FIELDS}

# The station metadata table, keyed by ``key``.
STATION_INFORMATION = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("short_name", T.StringType()),
        T.StructField("region_id", T.StringType()),
        T.StructField("rental_uris", T.StringType()),
        T.StructField("_ingested_at", T.TimestampType()),
        T.StructField("_source", T.StringType()),
    ]
)

# The enriched current status table, in its column order, with the side each column comes from.
CURRENT_STATUS = (
    ("station_id", "status", None),
    ("name", "info", None),
    ("lat", "info", None),
    ("lon", "info", None),
    ("ingested_at", "status", None),
    ("eightd_has_available_keys", "status", None),
    ("is_installed", "status", "int"),
    ("is_renting", "status", "int"),
    ("is_returning", "status", "int"),
    ("last_reported", "status", "bigint"),
    ("legacy_id", "status", None),
    ("num_bikes_available", "status", "int"),
    ("num_bikes_disabled", "status", "int"),
    ("num_docks_available", "status", "int"),
    ("num_docks_disabled", "status", "int"),
    ("num_ebikes_available", "status", "int"),
    ("num_scooters_available", "status", "int"),
    ("num_scooters_unavailable", "status", "int"),
    ("capacity", "info", "int"),
    ("short_name", "info", None),
)
