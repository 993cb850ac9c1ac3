"""The whole pipeline: landed polls and metadata to the current status table, live and in batch, and plan checks."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from conftest import SMALL_SKEW, final_plan, settings
from polls import expected_changes, land, random_polls
from spokeflow import session
from spokeflow.operators import records
from spokeflow.operators.analytics import low_availability
from spokeflow.operators.enrich import enrich
from spokeflow.plans.slate import QUERIES
from spokeflow.plans.stations import current_table, start_change_filter, start_current_table, status_log
from spokeflow.sinks.messages import information_messages, publish, status_messages
from spokeflow.sinks.serving import answer
from spokeflow.sources.snapshots import read_documents, read_information
from spokeflow.sources.topics import read_messages, station_information, status_events
from spokeflow.streaming.changes import parquet_publisher
from spokeflow.operators.records import decode_information
from spokeflow.streaming.run import drain

SF = "/root/testdata/sf0.01"


def test_live_pipeline_equals_batch(spark, path):
    polls = random_polls(11, polls=15, stations=6)
    for number, stations in polls.items():
        land(f"{path}/landing", number, stations)
    metadata = [{"station_id": str(n), "name": f"s{n}", "capacity": 20 + n, "lat": 40.0, "lon": -73.5} for n in range(4)]
    Path(f"{path}/metadata").mkdir()
    Path(f"{path}/metadata/information.json").write_text(json.dumps({"data": {"stations": metadata}}))

    # Metadata is seeded once.
    seed = records.decode_status(records.explode_stations(read_information(spark, f"{path}/metadata", "seed")))
    publish(information_messages(seed, "seed", F.lit(1704067200).cast("bigint")), "parquet", path=f"{path}/info_topic")

    # Polls become messages, with counts per poll.
    write_counts = parquet_publisher(f"{path}/counts")
    messages = parquet_publisher(f"{path}/topic")
    documents = read_documents(spark, f"{path}/landing", streaming=True, files_per_trigger=4)
    change_filter = start_change_filter(
        documents, f"{path}/filter", lambda rows, n: messages(status_messages(rows), n), every=None, report=write_counts
    )
    drain(change_filter)
    expected = expected_changes(polls)
    counts = spark.read.parquet(f"{path}/counts")
    assert counts.agg(F.sum("changed")).first()[0] == len(expected)
    assert counts.count() == sum(1 for rows in polls.values() if rows)

    # Messages keep the current status table and the list of low stations up to date.
    topic = read_messages(spark, "parquet", streaming=True, path=f"{path}/topic/batch=*")
    events = status_events(topic).withColumn("pos", F.col("num_bikes_available"))
    information = decode_information(read_messages(spark, "parquet", streaming=True, path=f"{path}/info_topic"))
    low = lambda now: low_availability(now, min_bikes=0, min_ratio=0.0)
    query, table = start_current_table(events, information, f"{path}/current", every=None, questions={"low": low})
    drain(query)

    log = status_log(read_documents(spark, f"{path}/landing")).withColumn("pos", F.col("num_bikes_available"))
    names = station_information(read_messages(spark, "parquet", path=f"{path}/info_topic"), ("_ingested_at",))
    wanted = current_table(log, names)
    order = lambda r: r.station_id
    live = table.read(spark).select(*wanted.columns)
    assert sorted(live.collect(), key=order) == sorted(wanted.collect(), key=order)
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    served = answer(spark, f"{path}/current/serving", "low").collect()
    assert served == answer(spark, f"{path}/current/serving", "low", last).collect()
    assert sorted(r.station_id for r in served) == sorted(r.station_id for r in low(wanted).collect())


def test_hot_station_in_the_batch_join_is_split(spark):
    status = spark.range(200_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("station_id"),
        *[
            F.col("id").cast(t).alias(n)
            for n, t in {"num_bikes_available": "int", "last_reported": "bigint", "legacy_id": "string"}.items()
        ],
        *[
            F.lit(None).cast(t).alias(n)
            for t, names in {
                "int": "is_installed is_renting is_returning num_bikes_disabled num_docks_available num_docks_disabled"
                " num_ebikes_available num_scooters_available num_scooters_unavailable",
                "timestamp": "ingested_at",
                "boolean": "eightd_has_available_keys",
            }.items()
            for n in names.split()
        ],
    )
    info = spark.range(5_000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        F.lit("n").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(3).alias("capacity"), F.lit("s").alias("short_name"),
    )
    with settings(spark, SMALL_SKEW):
        joined = enrich(status, info).select("station_id", "name", "last_reported", "legacy_id")
        assert "skew=true" in final_plan(joined)
        assert joined.count() == 200_000
    assert joined.where("station_id = 'hot' and name = 'n'").count() == 66_667


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_columns_they_need(spark):
    def read_schemas(name):
        found = plan(QUERIES[name](spark, SF))
        return [part.split(">")[0] for part in found.split("ReadSchema: struct<")[1:]]

    assert set(read_schemas("window_delta")) == {"event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double"}
    assert all("props" not in s for name in ("peak_hours_station", "poll_changes", "tumbling_5m") for s in read_schemas(name))


def test_filters_reach_the_scan_and_both_sides_of_the_join(spark):
    rows = QUERIES["enriched_log"](spark, SF).where("station_id = '7'")
    assert plan(rows).count("= 7)") >= 2


def test_no_python_and_no_cross_join_in_batch_queries(spark):
    for name, build in QUERIES.items():
        if not name.startswith("stream_"):
            found = plan(build(spark, SF))
            for slow in ("Python", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
                assert slow not in found, (name, slow)


def test_sized_settings():
    conf = session.sized_conf(100 * 2**40)
    assert conf["spark.sql.shuffle.partitions"] == str(409_600)
    assert session.sized_conf(1)["spark.sql.shuffle.partitions"] == "200"
