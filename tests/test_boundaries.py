"""Decoding, messages, topics, table loads, models, data tests and the session."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import final_plan
from spokeflow import session
from spokeflow.functions import decode
from spokeflow.operators import records
from spokeflow.operators.quality import primary_key, run_tests
from spokeflow.plans.models import Model, run, starter_models, without_null
from spokeflow.plans.stations import status_records
from spokeflow.sinks import messages
from spokeflow.sinks.tables import Layers, asset_name, write_table
from spokeflow.sources.relational import Connection, Split, jdbc_reader, load_tables, selected_tables
from spokeflow.sources.snapshots import read_documents, read_information
from spokeflow.sources.topics import read_messages, station_information, status_events
from spokeflow.streaming.run import drain, start_publishing


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string").select(decode.document(F.col("value")).alias("p"))


@pytest.mark.parametrize(
    "text, expected",
    [("3.0", 3), ("true", 1), ("3.7", 3), ('"7"', 7), ('"x"', None), ("null", None), ("false", 0), ("99999999999", None)],
)
def test_lenient_integers(spark, text, expected):
    row = payloads(spark, f'{{"f": {text}}}').select(
        decode.field(F.col("p"), "f", "int").alias("v"), decode.undecodable(F.col("p"), "f", "int").alias("bad")
    ).first()
    assert row.v == expected
    assert row.bad == (expected is None and text != "null")


def test_missing_fields_objects_and_instants(spark):
    row = payloads(spark, '{"o": {"a": 1}}').select(
        decode.field(F.col("p"), "none", "int").alias("none"),
        decode.field(F.col("p"), "o", "string").alias("o"),
        decode.iso_instant(F.lit("2024-01-01T00:00:30.123456+00:00")).alias("iso"),
        decode.iso_instant(F.lit("soon")).alias("junk"),
        decode.epoch_instant(F.lit(1704067200)).alias("epoch"),
    ).first()
    assert row.none is None and row.o == '{"a":1}' and row.junk is None
    assert row.iso == dt.datetime(2024, 1, 1, 0, 0, 30, 123456) and row.epoch == dt.datetime(2024, 1, 1)


def test_framed_values(spark):
    framed = spark.createDataFrame([(b"\x00\x00\x00\x00\x07" + '{"a": "é"}'.encode(),)], "value binary")
    assert framed.select(decode.text(F.col("value"), framed=True)).first()[0] == '{"a": "é"}'


def test_document_without_stations(spark, path):
    (folder := Path(path) / "landing").mkdir()
    (folder / "a.json").write_text('{"data": {}}')
    documents = read_documents(spark, str(folder))
    with pytest.raises(Exception, match="no data.stations"):
        records.explode_stations(documents, strict=True).collect()
    assert records.with_document_reason(documents).first().reject_reason == "no data.stations"


def test_documents_one_per_line(spark, path):
    lines = [json.dumps({"last_updated": 1704067200 + 30 * n, "data": {"stations": [{"station_id": str(n)}]}}) for n in range(3)]
    (Path(path) / "polls.jsonl").write_text("\n".join([*lines, "{broken"]))
    at = F.timestamp_seconds(decode.field(decode.document(F.col("value")), "last_updated", "bigint"))
    documents = read_documents(spark, f"{path}/polls.jsonl", feed=F.lit("f"), ingested_at=at, one_per_line=True)
    accepted, _ = status_records(documents)
    assert sorted((r.station_id, r.ingested_at.second) for r in accepted.collect()) == [("0", 0), ("1", 30), ("2", 0)]


def test_write_split_keeps_both_sides_in_one_pass(spark, path):
    rows = payloads(spark, '{"station_id": "1"}', "{}").select(F.lit(0).alias("pos"), F.col("p").alias("payload"))
    records.write_split(records.with_record_reason(rows), f"{path}/t")
    back = spark.read.parquet(f"{path}/t")
    assert {r.reject_reason: r.rejected for r in back.collect()} == {None: "false", "no station_id": "true"}


def test_information_is_published_and_read_back(spark, path):
    (folder := Path(path) / "landing").mkdir()
    stations = [{"station_id": "1", "name": "Ünter", "capacity": 9, "_source": "own", "extra": None}, {"station_id": "2"}]
    (folder / "information.json").write_text(json.dumps({"last_updated": 5, "data": {"stations": stations}}))
    documents = read_information(spark, str(folder), "https://example.org/feed")
    assert documents.first().last_updated == 5
    rows = records.decode_status(records.explode_stations(documents))
    out = messages.information_messages(rows, "https://example.org/feed", F.lit(1704067200).cast("bigint"))
    messages.publish(out, "parquet", path=f"{path}/topic")
    first = read_messages(spark, "parquet", path=f"{path}/topic").where("key = '1'").first()
    assert json.loads(first.value) == {**stations[0], "_ingested_at": 1704067200, "_source": "https://example.org/feed"}
    # A tombstone deletes the second station.
    spark.createDataFrame([(b"2", None)], "key binary, value binary").write.mode("append").parquet(f"{path}/topic")
    log = read_messages(spark, "parquet", path=f"{path}/topic").withColumn("offset", F.col("value").isNull().cast("int"))
    table = station_information(log, ("offset",)).collect()
    assert [(r.key, r.name, r.capacity, r._source) for r in table] == [("1", "Ünter", 9, "https://example.org/feed")]


def test_status_is_published_as_a_stream_and_read_back(spark, path):
    (folder := Path(path) / "landing").mkdir()
    station = {"station_id": "1", "num_bikes_available": 3, "ingested_at": "overridden", "new_field": [1, {"a": None}]}
    (folder / "a.json").write_text(json.dumps({"data": {"stations": [station]}}))
    at = F.lit("2024-01-01 00:00:30.123456").cast("timestamp")
    accepted, _ = status_records(read_documents(spark, str(folder), ingested_at=at, streaming=True))
    drain(start_publishing(messages.status_messages(accepted), "parquet", f"{path}/c", every=None, path=f"{path}/topic"))
    message = read_messages(spark, "parquet", path=f"{path}/topic")
    assert json.loads(message.first().value) == {**station, "ingested_at": "2024-01-01T00:00:30.123456+00:00"}
    event = status_events(message).first()
    assert (event.station_id, event.num_bikes_available) == ("1", 3)
    assert event.ingested_at == dt.datetime(2024, 1, 1, 0, 0, 30, 123456)


def test_kafka_is_read_from_the_start(spark):
    """The connector is not on this class path: the reader gets as far as looking it up."""
    with pytest.raises(Exception, match="(?i)kafka"):
        read_messages(spark, "kafka", subscribe="stations", **{"kafka.bootstrap.servers": "nowhere:1"})


def test_connection_options_do_not_show_the_password(spark):
    connection = Connection("jdbc:postgresql://db:5433/trips", "reader", "secret")
    assert connection.options() == {"url": "jdbc:postgresql://db:5433/trips", "user": "reader", "password": "secret"}
    assert "secret" not in repr(connection)
    assert Split("id", "0", "100", 8).options()["numPartitions"] == "8"


def test_one_task_for_a_table_is_an_explicit_choice(spark):
    read = jdbc_reader(spark, Connection("jdbc:none:x", "u", "p"), {"small": None})
    with pytest.raises(ValueError, match="split for big"):
        read("big")
    with pytest.raises(Exception, match="(?i)driver"):
        read("small")


def test_data_tests_none_and_misspelt(spark):
    rows = {"m": spark.createDataFrame([(1, None), (1, "a"), (None, None)], "id int, v string")}
    assert run_tests(spark, rows, {}).collect() == []
    with pytest.raises(ValueError, match="uniqe"):
        run_tests(spark, rows, {"m": {"id": ["uniqe"]}})
    found = run_tests(spark, rows, {"m": {"id": ["unique", "not_null"], "v": ["not_null", "unique"]}})
    assert sorted((r.column, r.test, r.failing_rows) for r in found.collect()) == [
        ("id", "not_null", 1), ("id", "unique", 1), ("v", "not_null", 2), ("v", "unique", 0),
    ]
    only = run_tests(spark, {"m": rows["m"].where("false")}, {"m": {"id": ["unique", "not_null"]}})
    assert sorted((r.test, r.failing_rows) for r in only.collect()) == [("not_null", 0), ("unique", 0)]


def test_selected_tables_are_loaded_under_their_asset_names(spark, path):
    manifest = spark.createDataFrame([("a", "nation"), ("b", "region"), ("c", "part")], "connection string, table_name string")
    names = sorted(r.table_name for r in selected_tables(manifest, ["a", "b"]).collect())
    layers = Layers("stage_test", "marts_test", path)
    layers.create(spark)
    load_tables(
        lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"),
        names,
        lambda rows, name: write_table(rows, f"{layers.staging}.{asset_name('TRIP', name)}"),
    )
    assert spark.table("stage_test.TRIP_NATION").count() == 25 and spark.table("stage_test.TRIP_REGION").count() == 5
    assert {r.tableName for r in spark.sql("show tables in stage_test").collect()} == {"trip_nation", "trip_region"}


def test_starter_models(spark, path):
    layers = Layers("starter_stage", "starter_marts", path)
    layers.create(spark)
    spark.sql("use starter_stage")
    try:
        results = {(r.model, r.test): r.failing_rows for r in run(spark, starter_models(spark)).collect()}
        assert results == {
            ("starter_first", "unique"): 0,
            ("starter_first", "not_null"): 1,
            ("starter_second", "unique"): 0,
            ("starter_second", "not_null"): 0,
        }
        first = spark.table("starter_first")
        assert sorted(r.id or 0 for r in first.collect()) == [0, 1]
        assert first.schema["id"].metadata["comment"] == "Identifies the row"
        assert without_null(first, "id").count() == spark.table("starter_second").count() == 1
        # Each run replaces the table.
        run(spark, starter_models(spark))
        assert spark.table("starter_first").count() == 2
    finally:
        spark.sql("use default")


def test_layered_models(spark, path):
    layers = Layers("model_stage", "model_marts", path)
    layers.create(spark)
    source = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, name string")
    models = [
        Model("trips", lambda ref: source, layer=layers.staging, tests={"id": ("unique", "not_null"), "name": ("not_null",)}),
        Model("names", lambda ref: ref("trips").select("name"), layer=layers.marts, tests={"name": ("unique",)}),
    ]
    results = {(r.model, r.column, r.test): r.failing_rows for r in run(spark, models).collect()}
    assert results == {
        ("trips", "id", "unique"): 1,
        ("trips", "id", "not_null"): 1,
        ("trips", "name", "not_null"): 0,
        ("names", "name", "unique"): 0,
    }
    assert spark.table("model_marts.names").count() == 3


def test_all_tests_of_a_model_take_one_scan_and_one_shuffle(spark, path):
    rows = [(i % 7, float(i % 3) * (-1) ** i, None if i % 5 == 0 else str(i), i) for i in range(60)] + [(None, None, None, 60)]
    spark.createDataFrame(rows, "a int, b double, c string, d int").write.parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/rows")
    both = ("unique", "not_null")
    found = run_tests(spark, {"m": table}, {"m": {"a": both, "b": both, "c": ("unique",), "d": both}})
    results = {(r.column, r.test): r.failing_rows for r in found.collect()}
    # 0.0 and -0.0 are one value; NULLs are not counted as repeated.
    assert results == {
        ("a", "unique"): 7, ("b", "unique"): 5, ("c", "unique"): 0, ("d", "unique"): 0,
        ("a", "not_null"): 1, ("b", "not_null"): 1, ("d", "not_null"): 0,
    }
    plan = final_plan(found)
    assert plan.split("Initial Plan")[0].count("FileScan") == 1
    assert plan.count("hashpartitioning") <= 2  # one exchange, in the final and in the initial plan
    empty = run_tests(spark, {"m": table.where("d < 0")}, {"m": {"a": both, "b": ("not_null",)}}).collect()
    assert {r.failing_rows for r in empty} == {0} and len(empty) == 3


def test_primary_key(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "key string")
    assert {r.test: r.failing_rows for r in primary_key(rows, "m", "key").collect()} == {"unique": 1, "not_null": 1}


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        assert session.run_dir(spark, "x").startswith(named)
    assert session.run_dir(spark, "x") != session.run_dir(spark, "x")
