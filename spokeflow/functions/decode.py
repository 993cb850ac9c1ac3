"""Lenient decoding of JSON payloads into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a registry frame is one magic byte and a four-byte schema id ahead of the JSON text.
FRAME_BYTES = 5


def text(value: Column, framed: bool = False) -> Column:
    """UTF-8 text of a message key or value."""
    raw = F.substring(value, FRAME_BYTES + 1, 2_147_483_647) if framed else value
    return F.decode(raw.cast("binary"), "UTF-8")


def schema_id(value: Column) -> Column:
    """The schema id in the frame of a message value; NULL if the value is no frame."""
    raw = value.cast("binary")
    framed = (F.length(raw) >= FRAME_BYTES) & (F.hex(F.substring(raw, 1, 1)) == "00")
    return F.when(framed, F.conv(F.hex(F.substring(raw, 2, FRAME_BYTES - 1)), 16, 10).cast("bigint"))


def document(value: Column) -> Column:
    """Parsed JSON; malformed text becomes NULL."""
    return F.try_parse_json(value)


def field(payload: Column, path: str, type_: str) -> Column:
    """One field of a payload, cast leniently: 3.0, true and "7" decode as integers, junk and absence as NULL."""
    return F.try_variant_get(payload, f"$.{path}", type_)


def whole(payload: Column, type_: str) -> Column:
    """All fields of a struct type in one look at the payload, each as lenient as :func:`field`."""
    return F.try_variant_get(payload, "$", type_)


def undecodable(payload: Column, path: str, type_: str) -> Column:
    """True where the field holds a value that the type cannot represent."""
    return field(payload, path, type_).isNull() & field(payload, path, "string").isNotNull()


def iso_instant(value: Column) -> Column:
    """An ISO-8601 string with an offset, as an instant."""
    return value.try_cast("timestamp")


def epoch_instant(value: Column) -> Column:
    """Epoch seconds, as an instant at millisecond precision."""
    return F.date_trunc("MILLISECOND", F.timestamp_seconds(value))
