"""Even ranges and incremental copies of database tables (Parquet stands in for the database), and values by schema id."""

import pytest
from pyspark.sql import functions as F

from spokeflow.operators.records import decode_by_schema
from spokeflow.sinks.versions import Versions, VersionTaken
from spokeflow.sources.relational import Connection, Increments, even_ranges, jdbc_range_reader


def counts(table, ranges):
    return [table.where(r).count() for r in ranges]


def test_skewed_keys_give_even_ranges(spark):
    """Nine tenths of the keys stand in a thousandth of their span."""
    table = spark.range(50_000).select(F.when(F.col("id") % 10 > 0, F.col("id")).otherwise(F.col("id") * 1_000).alias("k"))
    found = counts(table, even_ranges(table, "k", 8))
    assert sum(found) == 50_000 and len(found) == 8 and max(found) <= 50_000 / 8 * 1.02


def test_a_hot_value_fills_a_range_alone_and_missing_ones_another(spark):
    table = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 9 == 1, None).otherwise(F.col("id")).cast("int").alias("k")
    )
    ranges = even_ranges(table, "k", 10)
    found = counts(table, ranges)
    assert sum(found) == 9_000 and ranges[-1] == "k IS NULL" and found[-1] == 1_000
    assert sorted(found)[-1] in range(3_000, 3_010) and sorted(found)[-3] <= 1_000


@pytest.mark.parametrize("type_", ["date", "timestamp", "double", "decimal(12,2)"])
def test_ranges_of_other_types(spark, type_):
    start = F.lit("2024-01-01").cast(type_) if type_ in ("date", "timestamp") else None
    at = F.expr("date_add(date'2024-01-01', cast(id as int))").cast(type_) if start is not None else (F.col("id") / 7).cast(type_)
    table = spark.range(400).select(at.alias("k"))
    found = counts(table, even_ranges(table, "k", 4))
    assert sum(found) == 400 and max(found) <= 102


def test_ranges_of_little(spark):
    table = spark.createDataFrame([(None,), (3,)], "k int")
    assert counts(table.where("false"), even_ranges(table.where("false"), "k", 5)) == [0]
    assert sum(counts(table, even_ranges(table, "k", 5))) == 2
    assert counts(table, even_ranges(table, "k", 1)) == [1, 1]
    with pytest.raises(ValueError, match="at least one"):
        even_ranges(table, "k", 0)


def test_range_reader_names_its_tables(spark):
    read = jdbc_range_reader(spark, Connection("jdbc:none://host/db", "u", "p"), {"big": ["k <= 1", "k > 1"]})
    with pytest.raises(ValueError, match="ranges of small"):
        read("small")
    with pytest.raises(Exception, match="(?i)driver"):
        read("big")


def test_a_second_run_copies_new_rows_only(spark, path):
    copies = Increments(f"{path}/copy", "k")
    source = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    with pytest.raises(FileNotFoundError):
        copies.read(spark)
    assert copies.run(source.where("false")) is False
    assert copies.run(source.where("k < 60")) is True
    first = set(copies.read(spark).inputFiles())
    assert copies.run(source.withColumn("more", F.lit(1))) is True
    assert copies.run(source) is False
    rows = copies.read(spark)
    assert first < set(rows.inputFiles())
    assert sorted(tuple(r) for r in rows.collect()) == [(k, "a", None if k < 60 else 1) for k in range(100)]
    second = spark.read.parquet(*[f for f in rows.inputFiles() if f not in first])
    assert second.agg(F.min("k"), F.count("*")).first() == (60, 40)


def test_only_rows_above_the_mark_are_asked_for(spark, path):
    spark.range(100).select(F.col("id").alias("k")).write.parquet(f"{path}/source")
    copies = Increments(f"{path}/copy", "k")
    copies.run(spark.read.parquet(f"{path}/source"))
    mark = copies.versions.newest(spark)[1]["mark"]
    plan = spark.read.parquet(f"{path}/source").where((F.col("k") > F.lit(mark).cast("bigint")) | F.col("k").isNull())
    assert "PushedFilters: [Or(GreaterThan(k,99),IsNull(k))]" in plan._jdf.queryExecution().executedPlan().toString()


def test_a_lost_run_is_repeated_and_two_cannot_both_commit(spark, path, monkeypatch):
    copies = Increments(f"{path}/copy", "k")
    source = spark.range(10).select(F.col("id").cast("timestamp").alias("k"))
    copies.run(source.where("k < timestamp_seconds(4)"))
    with monkeypatch.context() as patched:
        def lost(*_, **__):
            raise RuntimeError("lost")

        patched.setattr(Versions, "commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            copies.run(source)
    assert copies.read(spark).count() == 4
    seen = copies.versions.newest(spark)
    copies.run(source)
    with monkeypatch.context() as patched:
        patched.setattr(Versions, "newest", lambda self, spark: seen)
        with pytest.raises(VersionTaken):
            copies.run(source)
    assert copies.read(spark).count() == copies.read(spark).distinct().count() == 10


def test_rows_without_a_mark_are_an_error(spark, path):
    copies = Increments(f"{path}/copy", "k")
    copies.run(spark.range(3).toDF("k"))
    with pytest.raises(ValueError, match="1 rows without k"):
        copies.run(spark.createDataFrame([(None,), (1,)], "k long"))


def frame(number, text):
    return bytearray(b"\x00" + number.to_bytes(4, "big") + text.encode())


def test_values_are_read_by_the_schema_of_their_frame(spark):
    schemas = {1: {"id": "station_id", "bikes": "bikes"}, 2**32 - 1: {"id": "station.id", "bikes": "available.bikes", "name": "name"}}
    rows = [
        (0, frame(1, '{"station_id": 7, "bikes": "3", "name": "not in this version"}')),
        (1, frame(2**32 - 1, '{"station": {"id": "8"}, "available": {"bikes": 4.0}, "name": "é"}')),
        (2, frame(3, '{"station_id": 9}')),
        (3, frame(1, "{")),
        (4, bytearray(b'{"station_id": 9}')),
        (5, None),
        (6, bytearray(b"")),
        (7, frame(1, '{"bikes": "many"}')),
    ]
    log = spark.createDataFrame(rows, "position int, value binary")
    found = decode_by_schema(log, schemas, {"id": "string", "bikes": "int", "name": "string"})
    assert [tuple(r) for r in found.orderBy("position").collect()] == [
        (0, 1, "7", 3, None, None, False),
        (1, 2**32 - 1, "8", 4, "é", None, False),
        (2, 3, None, None, None, "unknown schema 3", False),
        (3, 1, None, None, None, "not json", False),
        (4, None, None, None, None, "no frame", False),
        (5, None, None, None, None, None, True),
        (6, None, None, None, None, "no frame", False),
        (7, 1, None, None, None, None, False),
    ]
    with pytest.raises(ValueError, match="no type for other"):
        decode_by_schema(log, {1: {"other": "x"}}, {"id": "string"})
