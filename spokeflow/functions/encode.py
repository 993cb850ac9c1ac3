"""Encoding records as JSON messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(payload: Column, added: dict[str, Column]) -> Column:
    """The payload's own fields plus the added ones; an added field replaces one of the same name."""
    names = F.array(*[F.lit(n) for n in added])
    own = F.map_filter(payload.cast("map<string,variant>"), lambda name, _: ~F.array_contains(names, name))
    extra = F.create_map(*[part for n, c in added.items() for part in (F.lit(n), c.cast("variant"))])
    return F.map_concat(own, extra)


def json_text(record: Column) -> Column:
    """JSON of a struct or map; explicit nulls survive."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def utf8(value: Column) -> Column:
    return F.encode(value, "UTF-8")
