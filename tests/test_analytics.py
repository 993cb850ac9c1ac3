"""Neighbouring rows, windows, gaps and the operating questions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import settings
from spokeflow.operators.analytics import low_availability, peak_hours, time_weighted, usage_by_hour
from spokeflow.operators.neighbours import with_previous
from spokeflow.operators.windows import area_totals, change_since_previous, fill_forward, last_values, tumbling
from spokeflow.streaming.run import drain, start
from spokeflow.streaming.tumbling import tumbling_stream

LOG = "station_id string, ingested_at timestamp, pos bigint, num_bikes_available int"
ORDER = ("ingested_at", "pos")


def at(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def log(spark, *rows):
    return spark.createDataFrame([(s, at(m), i, v) for i, (s, m, v) in enumerate(rows)], LOG)


def skewed_rows(seed=0, rows=3000):
    """A third of the rows is one station, most of them within minutes; stations without a name take part too."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        if i % 3 == 0:
            out.append(("hot", at(rng.choice([rng.randint(0, 9), rng.randint(0, 6000)]), rng.randint(0, 59)), i, rng.choice([None, 1, 2, 9])))
        else:
            out.append((rng.choice([None, *"abcdefgh"]), at(rng.randint(0, 6000)), i, rng.randint(0, 9)))
    return out


def previous_by_hand(rows):
    last, out = {}, {}
    for sid, ts, pos, value in sorted(rows, key=lambda r: (r[1], r[2])):
        out[pos] = last.get(sid)
        last[sid] = (pos, value)
    return out


MINUTE = 60_000_000
CUTS = [{}, {"cell": MINUTE, "run": 3}, {"cell": 600 * MINUTE, "run": 50}, {"cell": 10**18, "run": 10**9}]


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("seed", [0, 1])
def test_previous_row_does_not_depend_on_the_cut(spark, cut, seed):
    rows = skewed_rows(seed)
    # Some rows have lost their time; they come first.
    rows = [(s, None if pos % 11 == 0 else ts, pos, v) for s, ts, pos, v in rows]
    df = spark.createDataFrame(rows, LOG)
    found = with_previous(df, "station_id", ORDER, ["pos", "num_bikes_available"], **cut).collect()
    by_hand = previous_by_hand([(s, (ts is not None, ts or at(0)), pos, v) for s, ts, pos, v in rows])
    assert {r.pos: tuple(r.previous) if r.previous else None for r in found} == by_hand
    assert len(found) == len(rows)


def test_building_the_window_reads_nothing(spark):
    df = spark.createDataFrame(skewed_rows(), LOG)
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    with_previous(df, "station_id", ORDER, ["pos"])
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before


def test_a_burst_of_one_instant_is_cut(spark):
    """No window sees more rows of a burst than a run, or than two for each run."""
    df = spark.range(60_000).select(
        F.lit("hot").alias("station_id"),
        F.lit(at(5)).alias("ingested_at"),
        F.col("id").alias("pos"),
        (F.col("id") % 7).cast("int").alias("num_bikes_available"),
    )
    found = with_previous(df, "station_id", ORDER, ["pos"], run=1_000)
    assert found.where("not previous.pos <=> nullif(pos, 0) - 1").isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_run" in plan


def test_usage_and_time_weight(spark):
    rows = [r for r in skewed_rows(3) if r[3] is not None]
    df = spark.createDataFrame(rows, LOG)
    usage, value_seconds, seconds, last = {}, {}, {}, {}
    for sid, ts, pos, value in sorted(rows, key=lambda r: (r[1], r[2])):
        if sid in last:
            before, held = last[sid]
            usage[sid, ts.hour] = usage.get((sid, ts.hour), 0) + abs(value - held)
            value_seconds[sid] = value_seconds.get(sid, 0) + held * int((ts - before).total_seconds())
            seconds[sid] = seconds.get(sid, 0) + int((ts - before).total_seconds())
        last[sid] = (ts, value)
    assert {(r.station_id, r.hour): r.usage for r in usage_by_hour(df).collect()} == usage
    weighted = {r.station_id: r for r in time_weighted(df).collect()}
    assert {s: r.value_seconds for s, r in weighted.items()} == value_seconds
    assert {s: r.seconds for s, r in weighted.items()} == seconds


def test_time_weight_of_a_single_row_is_unknown(spark):
    row = time_weighted(log(spark, ("1", 0, 5))).first()
    assert row.time_weighted is None and row.seconds is None


def test_time_weight_leaves_out_unknown_values(spark):
    row = time_weighted(log(spark, ("1", 0, 4), ("1", 1, None), ("1", 2, 8), ("1", 4, 0))).first()
    assert (row.value_seconds, row.seconds) == (4 * 60 + 8 * 120, 180)


def test_gap_fill(spark):
    rows = log(spark, ("1", 1, 5), ("1", 3, 6), ("1", 16, 9))
    filled = fill_forward(last_values(rows, ("station_id",), "ingested_at", "num_bikes_available", ORDER), ("station_id",))
    assert sorted((r.window_start, r.value) for r in filled.collect()) == [(at(0), 6), (at(5), 6), (at(10), 6), (at(15), 9)]


def test_area_totals_equal_the_sum_of_filled_stations(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcde"), rng.randint(0, 300), rng.choice([None, 0, 3, 7])) for _ in range(120)]
    values = last_values(log(spark, *rows), ("station_id",), "ingested_at", "num_bikes_available", ORDER)
    values = values.withColumn("area", F.when(F.col("station_id") < "c", "west")).select("area", *values.columns)
    expected = {}
    windows = sorted((r.window_start, r.area, r.station_id, r.value) for r in values.na.fill("-", ["area"]).collect())
    latest, end = {}, windows[-1][0]
    when = windows[0][0]
    while when <= end:
        for w, area, sid, value in windows:
            if w == when:
                latest[area, sid] = value
        for area in {a for a, _ in latest}:
            expected[area, when] = sum(v for (a, _), v in latest.items() if a == area)
        when += dt.timedelta(minutes=5)
    found = area_totals(values, "station_id", ("area",)).na.fill("-", ["area"])
    assert {(r.area, r.window_start): r.total for r in found.collect()} == expected


def test_change_within_and_between_windows(spark):
    rows = tumbling(log(spark, ("1", 0, 5), ("1", 4, 2), ("1", 11, 7)), ("station_id",), "ingested_at", "num_bikes_available", ORDER)
    found = change_since_previous(rows, ("station_id",)).orderBy("window_start").collect()
    assert [(r.n, r.min_value, r.max_value, r.first_value, r.last_value, r.change, r.change_since_previous) for r in found] == [
        (2, 2, 5, 5, 2, -3, None),
        (1, 7, 7, 7, 7, 0, 5),
    ]


def test_peak_hours_ties_go_to_the_earlier_hour_and_zone_shifts(spark):
    rows = log(spark, ("1", 0, 0), ("1", 30, 4), ("1", 90, 0), ("1", 150, 1))
    top = peak_hours(usage_by_hour(rows), "station_id", top=2).orderBy("rank").collect()
    assert [(r.hour, r.usage) for r in top] == [(0, 4), (1, 4)]
    shifted = usage_by_hour(rows, zone="America/New_York").collect()
    assert {r.hour: r.usage for r in shifted} == {19: 4, 20: 4, 21: 1}


def test_low_stations(spark):
    rows = spark.createDataFrame(
        [("few", 2, 40, 1), ("ratio", 4, 40, 1), ("ok", 5, 40, 1), ("closed", 0, 40, 0), ("bare", 3, None, 1), ("zero", 3, 0, 1), ("unknown", None, 40, 1)],
        "station_id string, num_bikes_available int, capacity int, is_renting int",
    )
    assert sorted(r.station_id for r in low_availability(rows).collect()) == ["few", "ratio"]


def test_late_rows(spark, path):
    """Watermark 2 minutes, window 5: behind the watermark a row still counts while its window is open."""
    batches = [[0, 20], [1, 17, 19], [40]]
    emitted = []
    query = None
    for minutes in batches:
        log(spark, *[("1", m, 1) for m in minutes]).coalesce(1).write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema(LOG).parquet(f"{path}/in")
        windows = tumbling_stream(rows, ("station_id",), "ingested_at", "num_bikes_available", ORDER, watermark="2 minutes")
        new = []
        query = start(windows, lambda df, _: new.extend((r.window_start, r.n) for r in df.collect()), f"{path}/c", "append", None)
        drain(query)
        emitted.append(sorted(new))
    assert emitted == [[(at(0), 1)], [], [(at(15), 2), (at(20), 1)]]


def test_window_plan_combines_before_the_shuffle(spark):
    rows = tumbling(log(spark, ("1", 0, 5)), ("station_id",), "ingested_at", "num_bikes_available", ORDER)
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        plan = rows.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan


@pytest.mark.parametrize("cut", CUTS)
def test_previous_known_row_does_not_depend_on_the_cut(spark, cut):
    rows = [(s, ts, pos, None if pos % 3 or pos % 5 == 0 else v) for s, ts, pos, v in skewed_rows(2)]
    df = spark.createDataFrame(rows, LOG)
    found = with_previous(df, "station_id", ORDER, ["pos", "num_bikes_available"], known="num_bikes_available", **cut).collect()
    known = previous_by_hand([r for r in rows if r[3] is not None])
    assert {r.pos: tuple(r.previous_known) if r.previous_known else None for r in found if r.num_bikes_available is not None} == known
    assert {r.pos: tuple(r.previous) if r.previous else None for r in found} == previous_by_hand(rows)
    assert all(r.previous_known is None for r in found if r.num_bikes_available is None)


def test_each_window_over_the_rows_is_computed_once(spark):
    df = spark.createDataFrame(skewed_rows(), LOG)
    plan = with_previous(df, "station_id", ORDER, ["pos"], known="pos")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Union" not in plan
