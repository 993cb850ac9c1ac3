"""Feed documents to typed station records, with the rejects kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeflow.functions import decode, encode
from spokeflow.schemas import STATION_INFORMATION, STATUS_FIELDS

STATIONS_PATH = "data.stations"


def explode_stations(documents: DataFrame, strict: bool = False) -> DataFrame:
    """One row per element of ``data.stations``, with its position ``pos`` and its ``payload``.

    An empty list leaves one row with NULLs, which tells that the poll took place. A document without the list is an
    error if ``strict``; otherwise leave it out beforehand with :func:`split_documents`.
    """
    stations = decode.field(F.col("document"), STATIONS_PATH, "array<variant>")
    if strict:
        stations = F.coalesce(stations, F.raise_error(F.lit(f"no {STATIONS_PATH} in the document")).cast("array<variant>"))
    columns = [c for c in documents.columns if c not in ("value", "document")]
    return documents.select(*columns, F.posexplode_outer(stations).alias("pos", "payload"))


def explode_status(documents: DataFrame) -> DataFrame:
    """:func:`explode_stations` with the typed status fields, ``reject_reason`` and ``unreadable``, decoded once per station.

    Only a station without an id is rejected. A field that cannot be read is NULL and listed in ``unreadable``; a tracked one
    is then an unknown state, which differs from a known one as any other state does. Decoding inside the list and not after
    it also keeps the optimizer from decoding again for each use of a field.
    """
    stations = decode.field(F.col("document"), STATIONS_PATH, "array<variant>")
    columns = [c for c in documents.columns if c not in ("value", "document")]
    return documents.select(*columns, F.posexplode_outer(_checked(stations, STATUS_FIELDS)).alias("pos", "station")).select(
        *columns, "pos", "station.payload", "station.typed.*", F.col("station.missing").alias("reject_reason"), "station.unreadable"
    )


def _checked(payloads: Column, fields: dict[str, str]) -> Column:
    """Each payload of a list with its typed fields, whether its station is ``missing`` and which fields are ``unreadable``.

    The fields are read in one look; a payload is searched again only for fields that came out NULL.
    """
    typed = ", ".join(f"{name} {type_}" for name, type_ in {"station_id": "string", **fields}.items())

    def read(payload: Column) -> Column:
        return F.struct(payload.alias("payload"), decode.whole(payload, f"struct<{typed}>").alias("typed"))

    def check(station: Column) -> Column:
        values, payload = station["typed"], station["payload"]
        bad = [
            F.when(values[n].isNull() & decode.field(payload, n, "string").isNotNull(), f"cannot read {n} as {t}")
            for n, t in fields.items()
        ]
        missing = F.when(values["station_id"].isNull(), "no station_id")
        unreadable = F.nullif(F.concat_ws("; ", *bad), F.lit(""))
        return F.struct(
            payload.alias("payload"), values.alias("typed"), missing.alias("missing"), unreadable.alias("unreadable")
        )

    return F.transform(F.transform(payloads, read), check)


def with_document_reason(documents: DataFrame) -> DataFrame:
    stations = decode.field(F.col("document"), STATIONS_PATH, "array<variant>")
    reason = F.when(F.col("document").isNull(), "not json").when(stations.isNull(), f"no {STATIONS_PATH}")
    return documents.withColumn("reject_reason", reason)


def count_stations(documents: DataFrame) -> DataFrame:
    """Documents with the number of stations in each."""
    stations = decode.field(F.col("document"), STATIONS_PATH, "array<variant>")
    return documents.withColumn("stations", F.size(stations))


def decode_status(records: DataFrame) -> DataFrame:
    """Typed status fields beside the whole payload, which keeps unknown fields."""
    p = F.col("payload")
    typed = {name: decode.field(p, name, type_) for name, type_ in STATUS_FIELDS.items()}
    return records.withColumns({"station_id": decode.field(p, "station_id", "string"), **typed})


def decode_information(messages: DataFrame) -> DataFrame:
    """Keyed metadata messages (``key`` string, ``value`` JSON text) as station information rows.

    Only the declared fields are read. A message without a value is a delete: ``deleted`` is true there, and the time of
    it is the message's own ``timestamp`` if the log has one.
    """
    p = F.col("_payload")
    typed = [
        decode.field(p, f.name, f.dataType.simpleString()).alias(f.name)
        for f in STATION_INFORMATION.fields
        if f.name not in ("key", "_ingested_at")
    ]
    ingested = decode.epoch_instant(decode.field(p, "_ingested_at", "bigint")).alias("_ingested_at")
    if "timestamp" in messages.columns:
        ingested = F.when(F.col("value").isNull(), F.col("timestamp")).otherwise(ingested).alias("_ingested_at")
    rest = [c for c in messages.columns if c not in ("key", "value")]
    return messages.withColumn("_payload", decode.document(F.col("value"))).select(
        "key", *typed, ingested, F.col("value").isNull().alias("deleted"), *rest
    )


def decode_by_schema(messages: DataFrame, schemas: dict[int, dict[str, str]], fields: dict[str, str]) -> DataFrame:
    """Framed messages (binary ``value``) of several schema versions as one set of columns.

    ``schemas`` is the registry: for every id, the path under which a version keeps a field; one it does not name is NULL.
    ``fields`` has the type of every field. Each row is parsed once and read by the version its frame names. ``reject_reason``
    tells of a value without a frame, an id that is not registered and text that is not JSON; a message without a value is
    a delete and no reject. The columns of the log other than ``value`` are kept.
    """
    unknown = {f for paths in schemas.values() for f in paths} - set(fields)
    if unknown:
        raise ValueError(f"no type for {', '.join(sorted(unknown))}")
    types = ", ".join(f"{name} {type_}" for name, type_ in fields.items())
    number, payload = F.col("_schema"), F.col("_payload")

    def version(paths: dict[str, str]) -> Column:
        read = [decode.field(payload, paths[f], t) if f in paths else F.lit(None).cast(t) for f, t in fields.items()]
        return F.struct(*[c.alias(f) for c, f in zip(read, fields, strict=True)])

    typed = F.lit(None).cast(f"struct<{types}>")
    for schema, paths in schemas.items():
        typed = F.when(number == schema, version(paths)).otherwise(typed)
    reason = (
        F.when(F.col("value").isNull(), F.lit(None))
        .when(number.isNull(), "no frame")
        .when(~number.isin(*schemas), F.concat(F.lit("unknown schema "), number))
        .when(payload.isNull(), "not json")
    )
    rest = [c for c in messages.columns if c != "value"]
    parsed = messages.withColumn("_schema", decode.schema_id(F.col("value"))).withColumn(
        "_payload", F.when(number.isin(*schemas), decode.document(decode.text(F.col("value"), framed=True)))
    )
    return parsed.select(
        *rest, number.alias("schema_id"), typed.alias("_typed"), reason.alias("reject_reason"), F.col("value").isNull().alias("deleted")
    ).select(*rest, "schema_id", *[F.col(f"_typed.{f}").alias(f) for f in fields], "reject_reason", "deleted")


def with_record_reason(records: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Add ``reject_reason`` to exploded records, strictly: no station, or the fields that do not decode; else NULL."""
    # Checked inside a list of one: as plain predicates beside the decoded columns, constraint inference would rewrite the
    # checks with every subset of those columns, which takes planning time exponential in their number.
    found = _checked(F.array("payload"), STATUS_FIELDS if fields is None else fields)[0]
    reason = F.coalesce(found["missing"], found["unreadable"])
    return records.withColumn("reject_reason", F.when(F.col("pos").isNotNull(), reason))


def issues(rows: DataFrame) -> DataFrame:
    """What was rejected, and what was accepted with an unreadable field, of rows with ``reject_reason`` and ``unreadable``."""
    known = [c for c in ("feed", "ingested_at", "pos", "station_id") if c in rows.columns]
    return rows.where("reject_reason is not null or unreadable is not null").select(
        *known,
        F.col("reject_reason").isNotNull().alias("rejected"),
        F.coalesce("reject_reason", "unreadable").alias("reason"),
        encode.json_text(F.col("payload")).alias("payload"),
    )


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reason."""
    accepted = flagged.where("reject_reason is null").drop("reject_reason")
    return accepted, flagged.where("reject_reason is not null")


def write_split(flagged: DataFrame, path: str) -> None:
    """Accepted and rejected rows in one pass, as the two partitions of one table."""
    flagged.withColumn("rejected", F.col("reject_reason").isNotNull()).write.mode("overwrite").partitionBy(
        "rejected"
    ).parquet(path)


def delivery_counts(flagged: DataFrame) -> DataFrame:
    """How many rows were accepted and how many were not, by reason (NULL: accepted)."""
    return flagged.groupBy("reject_reason").agg(F.count("*").alias("n"))
