"""Upsert tables, the enriched projection and the updating join, in batch and as a stream."""

import datetime as dt
import itertools
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spokeflow.operators.enrich import enrich
from spokeflow.operators.records import decode_information
from spokeflow.operators.upsert import latest
from spokeflow.plans.stations import current_table, start_current_table
from spokeflow.schemas import CURRENT_STATUS, STATION_INFORMATION, STATUS_FIELDS
from spokeflow.sinks import folders
from spokeflow.sinks.upsert import UpsertTable
from spokeflow.sinks.versions import Versions, VersionTaken
from spokeflow.sources.topics import station_information
from spokeflow.streaming.current import current_status
from spokeflow.streaming.run import drain

STATUS = "station_id string, ingested_at timestamp, pos int, " + ", ".join(f"{n} {t}" for n, t in STATUS_FIELDS.items())
INFO = "key string, name string, lat double, lon double, capacity int, short_name string, _ingested_at timestamp, deleted boolean"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute, 0, 123456)


def status(spark, *rows):
    nothing = dict.fromkeys(["station_id", "ingested_at", "pos", *STATUS_FIELDS])
    full = [{**nothing, "station_id": s, "ingested_at": at(m), "pos": 0, "num_bikes_available": b} for s, m, b in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], STATUS)


def info(spark, *rows):
    return spark.createDataFrame([(k, n, 40.7, -73.9, 30, n, at(m), d) for k, m, n, d in rows], INFO)


def test_enrich_has_the_20_columns(spark):
    rows = enrich(status(spark, ("1", 0, 5), (None, 0, 3), ("2", 0, 4)), info(spark, ("1", 0, "one", False)))
    assert rows.columns == [c for c, _, _ in CURRENT_STATUS]
    types = dict(rows.dtypes)
    assert types["last_reported"] == "bigint" and types["capacity"] == "int" and types["is_renting"] == "int"
    found = {r.station_id: (r.num_bikes_available, r.name, r.capacity) for r in rows.collect()}
    assert found == {"1": (5, "one", 30), None: (3, None, None), "2": (4, None, None)}


def test_strict_and_lenient_casts(spark):
    rows = status(spark, ("1", 0, 5)).withColumn("num_bikes_available", F.lit("many"))
    nothing = info(spark, ("2", 0, "two", False))
    assert enrich(rows, nothing, lenient=True).first().num_bikes_available is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        enrich(rows, nothing).collect()


def test_last_write_wins_and_deletes(spark):
    log = info(spark, ("1", 0, "old", False), ("1", 2, "new", False), ("2", 0, "two", False), ("2", 1, None, True))
    rows = latest(log, "key", ("_ingested_at",), deleted=F.col("deleted"))
    assert [(r.key, r.name) for r in rows.collect()] == [("1", "new")]


def test_station_information_is_decoded(spark):
    value = (
        '{"name": "Quai é", "lat": 40.5, "lon": -73, "capacity": 31.0, "short_name": "7", "region_id": 71,'
        ' "rental_uris": {"ios": "x"}, "unknown": 1, "_ingested_at": 1704067200, "_source": "feed"}'
    )
    rows = decode_information(spark.createDataFrame([("1", value), ("2", None)], "key string, value string"))
    assert set(rows.columns) == {*STATION_INFORMATION.names, "deleted"}
    one, two = sorted(rows.collect(), key=lambda r: r.key)
    assert (one.name, one.lat, one.lon, one.capacity, one.region_id) == ("Quai é", 40.5, -73.0, 31, "71")
    assert one.rental_uris == '{"ios":"x"}' and one._ingested_at == dt.datetime(2024, 1, 1) and not one.deleted
    assert two.deleted and two.name is None


def test_delete_takes_the_time_of_its_message(spark):
    log = spark.createDataFrame(
        [("1", '{"_ingested_at": 1704067200}', at(9)), ("1", None, at(5))], "key string, value string, timestamp timestamp"
    )
    rows = sorted(decode_information(log).collect(), key=lambda r: r.deleted)
    assert [(r._ingested_at, r.deleted) for r in rows] == [(dt.datetime(2024, 1, 1), False), (at(5), True)]


def test_log_order_decides_writes_and_deletes(spark):
    """All within one second, deletes without a time, as on the default file log; only the position orders them."""
    write = '{"name": "%s", "_ingested_at": 1704067200}'
    log = [("1", write % "a", 1), ("1", None, 2), ("2", None, 3), ("2", write % "b", 4), ("3", write % "c", 5), ("3", write % "d", 6)]
    messages = spark.createDataFrame(log[::-1], "key string, value string, position long")
    assert {(r.key, r.name) for r in station_information(messages).collect()} == {("2", "b"), ("3", "d")}
    renamed = messages.withColumnRenamed("position", "offset")
    assert {(r.key, r.name) for r in station_information(renamed).collect()} == {("2", "b"), ("3", "d")}
    with pytest.raises(ValueError, match="position"):
        station_information(messages.drop("position"))


def test_a_delete_at_a_later_place_takes_the_metadata_away(spark, path):
    """A tombstone without any time deletes, and a rewrite after it comes back, over several micro-batches."""
    write = '{"name": "%s", "_ingested_at": 1704067200}'
    steps = [(write % "one", "one"), (None, None), (write % "two", "two"), (None, None)]
    schema = "key string, value string, position long"
    status(spark, ("1", 0, 5)).coalesce(1).write.parquet(f"{path}/s")
    spark.createDataFrame([], schema).write.parquet(f"{path}/i")
    for place, (value, expected) in enumerate(steps):
        spark.createDataFrame([("1", value, place)], schema).coalesce(1).write.mode("append").parquet(f"{path}/i")
        info_rows = decode_information(spark.readStream.schema(schema).parquet(f"{path}/i"))
        query, table = start_current_table(spark.readStream.schema(STATUS).parquet(f"{path}/s"), info_rows, path, every=None)
        drain(query)
        assert [(r.num_bikes_available, r.name) for r in table.read(spark).collect()] == [(5, expected)]


def test_no_python_in_the_updating_join(spark):
    plan = current_status(status(spark, ("1", 0, 5)), info(spark, ("1", 0, "one", False)))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def stream_of(spark, folder, batches):
    """A file stream that delivers each frame as one micro-batch."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_updating_join_trace(spark, path):
    """Both sides update the joined row; an older status loses; a delete takes the metadata away again."""
    steps = [
        (status(spark, ("1", 0, 5)), None, (5, None)),
        (None, info(spark, ("1", 1, "one", False)), (5, "one")),
        (status(spark, ("1", 2, 7)), None, (7, "one")),
        (status(spark, ("1", 1, 6)), None, (7, "one")),
        (None, info(spark, ("1", 3, None, True)), (7, None)),
        (None, info(spark, ("1", 2, "late", False)), (7, None)),
    ]
    s, i = f"{path}/status", f"{path}/info"
    status(spark).write.parquet(s)
    info(spark).write.parquet(i)
    for new_status, new_info, expected in steps:
        for rows, folder in ((new_status, s), (new_info, i)):
            if rows is not None:
                rows.coalesce(1).write.mode("append").parquet(folder)
        query, table = start_current_table(
            spark.readStream.schema(STATUS).parquet(s), spark.readStream.schema(INFO).parquet(i), path, every=None
        )
        drain(query)
        row = table.read(spark).collect()
        assert [(r.num_bikes_available, r.name) for r in row] == [expected]
        assert row[0].ingested_at == (at(0) if expected[0] == 5 else at(2))


@pytest.mark.parametrize("order", [0, 1])
def test_stream_equals_batch_in_any_order(spark, path, order):
    statuses = [
        status(spark, *[(str(n % 7), m, n * m) for n in range(10)], (None, m, 1)) for m in (3, 1, 2)
    ]
    infos = [info(spark, *[(str(n), m, f"{n}-{m}", n == 4 and m == 2) for n in range(m, 6)]) for m in (0, 1, 2)]
    log = list(itertools.permutations(statuses))[order * 5]
    names = list(itertools.permutations(infos))[order * 3]
    query, table = start_current_table(
        stream_of(spark, f"{path}/s", [b.withColumn("pos", F.col("num_bikes_available")) for b in log]),
        stream_of(spark, f"{path}/i", names),
        path,
        every=None,
    )
    drain(query)
    whole = statuses[0].unionByName(statuses[1]).unionByName(statuses[2]).where("station_id is not null")
    metadata = infos[0].unionByName(infos[1]).unionByName(infos[2])
    expected = current_table(
        whole.withColumn("pos", F.col("num_bikes_available")),
        latest(metadata, "key", ("_ingested_at",), deleted=F.col("deleted")),
    )
    key = lambda r: r.station_id
    assert sorted(table.read(spark).select(*expected.columns).collect(), key=key) == sorted(expected.collect(), key=key)


def test_hot_station_in_the_updating_join(spark, path):
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("station_id"),
        F.timestamp_seconds(F.col("id")).alias("ingested_at"),
        F.col("id").cast("int").alias("pos"),
        *[(F.col("id") if n == "num_bikes_available" else F.lit(None)).cast(t).alias(n) for n, t in STATUS_FIELDS.items()],
    )
    query, table = start_current_table(
        stream_of(spark, f"{path}/s", [hot]), stream_of(spark, f"{path}/i", [info(spark, ("hot", 0, "h", False))]), path, every=None
    )
    drain(query)
    rows = {r.station_id: (r.num_bikes_available, r.name) for r in table.read(spark).collect()}
    assert len(rows) == 501 and rows["hot"] == (59_997, "h")


def test_upsert_table_compacts_replays_and_reads_back(spark, path):
    table = UpsertTable(f"{path}/t", ("k",), compact_every=3)
    with pytest.raises(FileNotFoundError):
        table.read(spark)
    for batch in range(8):
        rows = spark.createDataFrame([(k, batch) for k in {batch % 4, 9}], "k int, v int")
        table.write_batch(rows, batch)
        table.write_batch(rows, batch)
    read = lambda upto=None: {r.k: r.v for r in table.read(spark, upto).collect()}
    assert read() == {0: 4, 1: 5, 2: 6, 3: 7, 9: 7}
    assert read(upto=5) == {0: 4, 1: 5, 2: 2, 3: 3, 9: 5}
    # Only the newest base and the batch after it are read.
    assert len(table.read(spark).inputFiles()) < 8


def test_a_long_lived_table_keeps_few_folders(spark, path):
    table = UpsertTable(f"{path}/t", ("k",), compact_every=5)
    rows = spark.createDataFrame([(1, 1)], "k int, v int").coalesce(1)
    most = 0
    for batch in range(110):
        table.write_batch(rows.withColumn("v", F.lit(batch)), batch)
        most = max(most, len(list(Path(f"{path}/t/log").iterdir())) + len(list(Path(f"{path}/t/base").iterdir())) if batch > 5 else 0)
    assert most <= 14
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, 109)]


def test_readers_open_one_version_and_list_nothing(spark, path, monkeypatch):
    """Also a reader that opened its version before a compaction, and after the last writer was lost before ``_newest``."""
    table = UpsertTable(f"{path}/t", ("k",), compact_every=3)
    rows = lambda batch: spark.createDataFrame([(batch % 2, batch)], "k int, v int")
    for batch in range(5):
        table.write_batch(rows(batch), batch)
    before = table.read(spark)
    table.write_batch(rows(5), 5)
    assert {r.k: r.v for r in before.collect()} == {0: 4, 1: 3}
    (Path(f"{path}/t/versions/_newest")).write_text(json.dumps({"number": 3}))
    Path(f"{path}/t/versions/._newest.crc").unlink(missing_ok=True)

    def listed(*_):
        raise AssertionError("a reader listed folders")

    monkeypatch.setattr(folders, "_found", listed)
    assert {r.k: r.v for r in table.read(spark).collect()} == {0: 4, 1: 5}
    assert {r.k: r.v for r in table.read(spark, 4).collect()} == {0: 4, 1: 3}
    assert table.versions.newest(spark)[1]["folders"][0].startswith("base/batch=5-")


def test_two_writers_cannot_commit_one_version(spark, path, monkeypatch):
    """The second one had read the table before the first one committed; its folder stays out, and coming again it is done."""
    table = UpsertTable(f"{path}/t", ("k",))
    rows = lambda v: spark.createDataFrame([(1, v)], "k int, v int")
    table.write_batch(rows(0), 0)
    seen = table.versions.newest(spark)
    table.write_batch(rows(1), 1)
    with monkeypatch.context() as patched:
        patched.setattr(Versions, "newest", lambda self, spark: seen)
        with pytest.raises(VersionTaken):
            table.write_batch(rows(99), 1)
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, 1)]
    table.write_batch(rows(99), 1)
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, 1)]
    assert sorted(p.name[0] for p in Path(f"{path}/t/versions").glob("*.json")) == ["1", "2"]


def test_removed_versions_are_an_error(spark, path):
    table = UpsertTable(f"{path}/t", ("k",), compact_every=2)
    for batch in range(8):
        table.write_batch(spark.createDataFrame([(1, batch)], "k int, v int"), batch)
    assert [r.v for r in table.read(spark, 5).collect()] == [5]
    with pytest.raises(FileNotFoundError, match="as of batch 2"):
        table.read(spark, 2)
    assert not table.written(spark, 2) and table.written(spark, 6)
    assert len(list(Path(f"{path}/t/versions").glob("*.json"))) <= 5
