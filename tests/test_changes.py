"""The change filter: golden trace, random polls against brute force, batch against stream, replays, hot stations."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import NO_BROADCAST, SMALL_SKEW, final_plan, settings
from polls import GOLDEN, GOLDEN_CHANGES, T0, expected_changes, land, random_polls
from spokeflow.operators.changes import flag_changes, poll_counts
from spokeflow.plans.stations import log_issues, start_change_filter, status_log, status_records
from spokeflow.sources.snapshots import read_documents
from spokeflow.streaming.changes import ChangeFilter, parquet_publisher
from spokeflow.streaming.run import drain


def number(row):
    return int((row.ingested_at.timestamp() - T0) / 30)


def landed(path, polls, name="landing"):
    folder = f"{path}/{name}"
    for n, stations in polls.items():
        land(folder, n, stations)
    return folder


def test_golden_batch(spark, path):
    log = status_log(read_documents(spark, landed(path, GOLDEN)))
    assert sorted((number(r), r.station_id, r.num_bikes_available) for r in log.collect()) == GOLDEN_CHANGES


@pytest.mark.parametrize("files", [1, 4, 100])
def test_golden_stream(spark, path, files):
    documents = read_documents(spark, landed(path, GOLDEN), streaming=True, files_per_trigger=files)
    drain(start_change_filter(documents, f"{path}/run", parquet_publisher(f"{path}/out"), every=None))
    rows = spark.read.parquet(f"{path}/out").collect()
    assert sorted((number(r), r.station_id, r.num_bikes_available) for r in rows) == GOLDEN_CHANGES


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batch_and_stream(spark, path, seed):
    polls = random_polls(seed, polls=24, stations=9)
    folder = landed(path, polls)
    expected = expected_changes(polls)
    batch = status_log(read_documents(spark, folder)).collect()
    assert sorted((number(r), r.pos) for r in batch) == expected
    if seed == 1:
        documents = read_documents(spark, folder, streaming=True, files_per_trigger=7)
        drain(start_change_filter(documents, f"{path}/run", parquet_publisher(f"{path}/out"), every=None))
        assert sorted((number(r), r.pos) for r in spark.read.parquet(f"{path}/out").collect()) == expected


def test_stream_goes_on_after_a_restart(spark, path):
    first = {n: s for n, s in GOLDEN.items() if n < 5}
    for part in (first, {n: s for n, s in GOLDEN.items() if n >= 5}):
        documents = read_documents(spark, landed(path, part), streaming=True)
        drain(start_change_filter(documents, f"{path}/run", parquet_publisher(f"{path}/out"), every=None))
    rows = spark.read.parquet(f"{path}/out").collect()
    assert sorted((number(r), r.station_id, r.num_bikes_available) for r in rows) == GOLDEN_CHANGES


def test_failed_publish_is_tried_again(spark, path):
    folder = landed(path, GOLDEN)
    write = parquet_publisher(f"{path}/out")
    failed = []

    def flaky(changed, batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise OSError("broker away")
        write(changed, batch_id)

    def run():
        documents = read_documents(spark, folder, streaming=True, files_per_trigger=3)
        drain(start_change_filter(documents, f"{path}/run", flaky, every=None))

    with pytest.raises(Exception, match="broker away"):
        run()
    run()
    rows = spark.read.parquet(f"{path}/out").collect()
    assert sorted((number(r), r.station_id, r.num_bikes_available) for r in rows) == GOLDEN_CHANGES


def test_replayed_batch_gives_the_same_answer(spark, path):
    accepted, _ = status_records(read_documents(spark, landed(path, GOLDEN)))
    accepted = accepted.withColumn("n", ((F.unix_seconds("ingested_at") - T0) / 30).cast("int"))
    step = ChangeFilter(f"{path}/states", parquet_publisher(f"{path}/out"))
    for batch_id, (low, high) in enumerate([(0, 4), (4, 7), (7, 11)]):
        for _ in range(2):
            step.process(accepted.where((F.col("n") >= low) & (F.col("n") < high)), batch_id)
    rows = spark.read.parquet(f"{path}/out").collect()
    assert sorted((number(r), r.station_id, r.num_bikes_available) for r in rows) == GOLDEN_CHANGES


def test_feeds_are_independent(spark, path):
    for n, stations in GOLDEN.items():
        land(f"{path}/landing/north", n, stations)
        if n != 3:
            land(f"{path}/landing/south", n, stations)
    log = status_log(read_documents(spark, f"{path}/landing/*"))
    found = sorted((r.feed, number(r), r.station_id, r.num_bikes_available) for r in log.collect())
    # Without poll 3 the south never misses A, so A does not come back in poll 4.
    south = [("south", *c) for c in GOLDEN_CHANGES if c != (4, "A", 5)]
    assert found == [("north", *c) for c in GOLDEN_CHANGES] + south


def test_polls_without_any_broadcast(spark, path):
    polls = random_polls(7, polls=20, stations=6)
    accepted, _ = status_records(read_documents(spark, landed(path, polls)))
    with settings(spark, NO_BROADCAST):
        changes = flag_changes(accepted).where("changed")
        assert "BroadcastHashJoin" not in final_plan(changes)
        assert sorted((number(r), r.pos) for r in changes.collect()) == expected_changes(polls)


def test_poll_counts(spark, path):
    polls = random_polls(5, polls=12, stations=6)
    accepted, _ = status_records(read_documents(spark, landed(path, polls)))
    counts = {number(r): (r.changed, r.total) for r in poll_counts(flag_changes(accepted)).collect()}
    changes = expected_changes(polls)
    assert counts == {n: (sum(c[0] == n for c in changes), len(rows)) for n, rows in polls.items() if rows}


def test_rejects_are_kept_aside(spark, path):
    """A record without a station is rejected; one with an unreadable field is accepted and reported; a document is a row."""
    land(f"{path}/landing", 1, "{broken")
    land(f"{path}/landing", 2, json.dumps({"data": {}}))
    land(f"{path}/landing", 3, [{"num_bikes_available": 1}, {"station_id": "A", "num_bikes_available": "x"}, {"station_id": "B"}])
    documents = read_documents(spark, f"{path}/landing")
    accepted, found = status_records(documents)
    assert sorted(r.station_id for r in accepted.collect()) == ["A", "B"]
    wanted = [
        (False, "cannot read num_bikes_available as int"),
        (True, "no data.stations"),
        (True, "no station_id"),
        (True, "not json"),
    ]
    assert sorted((r.rejected, r.reason) for r in found.collect()) == wanted
    status_log(documents, f"{path}/staged")
    assert sorted((r.rejected, r.reason) for r in log_issues(spark, f"{path}/staged").collect()) == wanted
    drain(start_change_filter(read_documents(spark, f"{path}/landing", streaming=True), f"{path}/run", parquet_publisher(f"{path}/out"), every=None))
    assert sorted((r.rejected, r.reason) for r in spark.read.parquet(f"{path}/run/issues").collect()) == wanted


def published(spark, folder, path, **options):
    documents = read_documents(spark, folder, streaming=True, **options)
    drain(start_change_filter(documents, f"{path}/run", parquet_publisher(f"{path}/out"), every=None))
    rows = spark.read.parquet(f"{path}/out")
    return sorted((number(r), r.station_id, r.num_bikes_available) for r in rows.collect())


def test_an_unreadable_untracked_field_loses_no_change(spark, path):
    steady = {"station_id": "S", "num_bikes_available": 9, "last_reported": 1}
    for n, (bikes, keys) in enumerate([(5, False), (0, "unknown"), (5, False)]):
        land(f"{path}/landing", n, [{"station_id": "A", "num_bikes_available": bikes, "eightd_has_available_keys": keys}, steady])
    steady["last_reported"] = "junk"
    land(f"{path}/landing", 3, [{"station_id": "A", "num_bikes_available": 5}, steady])
    land(f"{path}/landing", 4, [{"station_id": "A", "num_bikes_available": 5}, {**steady, "last_reported": 2}])
    wanted = [(0, "A", 5), (0, "S", 9), (1, "A", 0), (2, "A", 5)]
    log = status_log(read_documents(spark, f"{path}/landing"))
    assert sorted((number(r), r.station_id, r.num_bikes_available) for r in log.collect()) == wanted
    assert published(spark, f"{path}/landing", path, files_per_trigger=1) == wanted


def test_a_poll_of_rejects_took_place(spark, path):
    """After a poll in which every record was rejected, all stations are new again, as after an empty poll."""
    land(f"{path}/landing", 0, [{"station_id": "A", "num_bikes_available": 5}])
    land(f"{path}/landing", 1, [{"num_bikes_available": 5}])
    land(f"{path}/landing", 2, [{"station_id": "A", "num_bikes_available": 5}])
    wanted = [(0, "A", 5), (2, "A", 5)]
    log = status_log(read_documents(spark, f"{path}/landing"))
    assert sorted((number(r), r.station_id, r.num_bikes_available) for r in log.collect()) == wanted
    assert published(spark, f"{path}/landing", path, files_per_trigger=1) == wanted


def records_at(spark, *rows):
    typed = [("f", dt.datetime(2024, 1, 1, 0, minute), pos, station, bikes) for minute, pos, station, bikes in rows]
    return spark.createDataFrame(typed, "feed string, ingested_at timestamp, pos int, station_id string, v int")


def test_a_poll_over_two_batches_and_a_late_one(spark, path):
    late = []
    step = ChangeFilter(
        f"{path}/states", parquet_publisher(f"{path}/out"), ("v",), late=lambda rows, n: late.extend((n, r.station_id) for r in rows.collect())
    )
    step.process(records_at(spark, (0, 0, "A", 1), (0, 1, "B", 1)), 0)
    step.process(records_at(spark, (1, 0, "A", 1)), 1)
    step.process(records_at(spark, (1, 1, "B", 1), (2, 0, "A", 1), (2, 1, "B", 2)), 2)
    step.process(records_at(spark, (1, 2, "C", 1), (3, 0, "A", 1), (3, 1, "B", 2)), 3)
    found = sorted((r.ingested_at.minute, r.station_id, r.v) for r in spark.read.parquet(f"{path}/out").collect())
    assert found == [(0, "A", 1), (0, "B", 1), (2, "B", 2)]
    assert late == [(3, "C")]


def test_building_the_filter_reads_nothing(spark):
    rows = records_at(spark, (0, 0, "A", 1))
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    flag_changes(rows, ("v",))
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before


def test_hot_station_is_split(spark):
    """A third of the rows is one station in one poll: adaptive execution cuts that partition."""
    rows = spark.range(300_000, numPartitions=8).select(
        F.lit("f").alias("feed"),
        F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 60).otherwise(F.col("id") % 2 * 30)).alias("ingested_at"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50_000).cast("string")).alias("station_id"),
        (F.col("id") % 5).cast("int").alias("v"),
    )
    with settings(spark, SMALL_SKEW):
        flagged = flag_changes(rows, ("v",)).select("pos", "changed")
        assert "skew=true" in final_plan(flagged)
        found = flagged.collect()
    assert len(found) == 300_000
    assert sum(r.changed for r in found if r.pos % 3 == 0) == 100_000
