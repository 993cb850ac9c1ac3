"""The operators on the TPC-H-like test tables.

``events`` stands for the status log (user → station, ``ts`` → time of the poll, ``value`` → bikes), ``supplier`` for
the station metadata, which covers only part of the stations, and ``nation``/``region`` for the regions.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spokeflow.functions import decode, encode
from spokeflow.operators import records
from spokeflow.operators.analytics import (
    low_availability, mean_over_time, peak_hours, time_weighted, usage_by_hour, with_region,
)
from spokeflow.operators.records import decode_information
from spokeflow.operators.changes import flag_changes, poll_counts
from spokeflow.operators.enrich import enrich
from spokeflow.operators.quality import primary_key, run_tests
from spokeflow.operators.upsert import folded, latest
from spokeflow.operators.windows import area_totals, change_since_previous, fill_forward, last_values, tumbling
from spokeflow.plans.models import Model, TestsFailed, materialize, union_all
from spokeflow.plans.models import run as run_models
from spokeflow.plans.stations import start_current_table
from spokeflow.schemas import STATUS_FIELDS
from spokeflow.session import configure, run_dir
from spokeflow.sinks import folders
from spokeflow.sinks.messages import information_messages, status_messages
from spokeflow.sinks.serving import answer
from spokeflow.sinks.tables import Layers, asset_name, write_path
from spokeflow.sinks.upsert import ChangelogTable, UpsertTable
from spokeflow.sources.relational import Increments, even_ranges, load_tables, selected_tables
from spokeflow.sources.topics import station_information, status_events
from spokeflow.streaming.changes import ChangeFilter, parquet_publisher
from spokeflow.streaming.current import current_status
from spokeflow.streaming.history import CorrectingFilter
from spokeflow.streaming.run import drain, start
from spokeflow.streaming.totals import AreaTotals, moved_stream
from spokeflow.streaming.tumbling import tumbling_stream
from spokeflow.streaming.usage import LiveUsage

ORDER = ("ingested_at", "pos")
DAY = "1 day"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # The pattern lets the table be a single file as well as a folder of them.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def as_status(events: DataFrame) -> DataFrame:
    props = decode.document(F.col("props"))
    flag = lambda condition: F.col("event_type").eqNullSafe(condition).cast("int")
    nothing = F.lit(None).cast("int")
    return events.select(
        F.lit("events").alias("feed"),
        F.col("user_id").cast("string").alias("station_id"),
        F.col("ts").alias("ingested_at"),
        F.col("event_id").alias("pos"),
        "event_type",
        F.col("value").cast("int").alias("num_bikes_available"),
        decode.field(props, "k", "int").alias("num_docks_available"),
        nothing.alias("num_ebikes_available"),
        nothing.alias("num_bikes_disabled"),
        nothing.alias("num_docks_disabled"),
        nothing.alias("num_scooters_available"),
        nothing.alias("num_scooters_unavailable"),
        (1 - flag("signup")).alias("is_installed"),
        (1 - flag("error")).alias("is_renting"),
        (1 - flag("view")).alias("is_returning"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("last_reported"),
        F.col("event_type").eqNullSafe("click").alias("eightd_has_available_keys"),
        F.col("event_id").cast("string").alias("legacy_id"),
    )


def as_information(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").cast("string").alias("key"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.col("s_acctbal").cast("int").alias("capacity"),
        F.upper("s_name").alias("short_name"),
        F.col("s_nationkey").cast("string").alias("region_id"),
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_status(table(spark, sf_dir, "events"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last status of each station: the raw events are reduced first, so that only the rows kept are decoded."""
    return as_status(latest(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id")))


def information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_information(table(spark, sf_dir, "supplier"))


def station_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region of each station that has metadata, in the shape :func:`with_region` reads."""
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
        .join(region, nation.n_regionkey == region.r_regionkey, "left")
        .select(F.col("s_suppkey").cast("string").alias("key"), F.col("r_name").alias("region_id"))
    )


@query
def latest_status(spark, sf_dir):
    return current(spark, sf_dir).select(
        "station_id", *ORDER, "event_type", "num_bikes_available", "num_docks_available"
    )


@query
def enriched_current(spark, sf_dir):
    return enrich(current(spark, sf_dir), information(spark, sf_dir))


@query
def enriched_log(spark, sf_dir):
    return enrich(status(spark, sf_dir), information(spark, sf_dir))


@query
def low_stations(spark, sf_dir):
    enriched = enrich(current(spark, sf_dir), information(spark, sf_dir))
    low = low_availability(enriched, min_bikes=10, min_ratio=0.01)
    return low.select("station_id", "name", "num_bikes_available", "capacity", "is_renting")


def daily_polls(rows: DataFrame) -> DataFrame:
    """One poll per day; a station's records of a day are its duplicates in that poll."""
    return rows.select(
        "feed", F.date_trunc("DAY", "ingested_at").alias("ingested_at"), "pos", "station_id", "event_type", "is_renting"
    )


@query
def poll_changes(spark, sf_dir):
    rows = flag_changes(daily_polls(status(spark, sf_dir)), ("event_type",))
    return rows.where("changed").select("station_id", F.col("ingested_at").cast("timestamp_ntz").alias("poll"), "pos", "event_type")


@query
def poll_change_counts(spark, sf_dir):
    rows = flag_changes(daily_polls(status(spark, sf_dir)), ("event_type", "is_renting"))
    return poll_counts(rows).select(F.col("ingested_at").cast("timestamp_ntz").alias("poll"), "changed", "total")


@query
def peak_hours_station(spark, sf_dir):
    usage = usage_by_hour(status(spark, sf_dir))
    return peak_hours(usage, "station_id").withColumn("hour", F.col("hour").cast("bigint"))


@query
def peak_hours_region(spark, sf_dir):
    usage = with_region(usage_by_hour(status(spark, sf_dir)), station_regions(spark, sf_dir))
    return peak_hours(usage, "region_id").withColumn("hour", F.col("hour").cast("bigint"))


@query
def usage_with_gaps(spark, sf_dir):
    """Usage where errors have lost their time, views their value, and all times are cut to the hour."""
    rows = status(spark, sf_dir)
    kind = F.col("event_type")
    rows = rows.withColumns(
        {
            "ingested_at": F.when(kind != "error", F.date_trunc("HOUR", "ingested_at")),
            "num_bikes_available": F.when(kind != "view", F.col("num_bikes_available")),
        }
    )
    return usage_by_hour(rows).withColumn("hour", F.col("hour").cast("bigint"))


@query
def tumbling_5m(spark, sf_dir):
    rows = tumbling(status(spark, sf_dir), ("event_type",), "ingested_at", "num_bikes_available", ORDER)
    return rows.withColumn("avg_value", F.round("avg_value", 6))


@query
def tumbling_5m_station(spark, sf_dir):
    rows = tumbling(status(spark, sf_dir), ("station_id",), "ingested_at", "num_bikes_available", ORDER)
    return change_since_previous(rows, ("station_id",)).withColumn("avg_value", F.round("avg_value", 6))


@query
def window_delta(spark, sf_dir):
    rows = tumbling(status(spark, sf_dir), ("station_id",), "ingested_at", "num_bikes_available", ORDER, DAY)
    deltas = change_since_previous(rows, ("station_id",))
    return deltas.select("station_id", "window_start", "last_value", "change_since_previous")


def daily_values(spark, sf_dir):
    return last_values(status(spark, sf_dir), ("station_id",), "ingested_at", "num_bikes_available", ORDER, DAY)


@query
def area_carry_forward(spark, sf_dir):
    return area_totals(daily_values(spark, sf_dir), "station_id", interval=DAY)


@query
def area_carry_forward_5m(spark, sf_dir):
    values = last_values(status(spark, sf_dir), ("station_id",), "ingested_at", "num_bikes_available", ORDER)
    return area_totals(values, "station_id")


@query
def region_carry_forward(spark, sf_dir):
    values = with_region(daily_values(spark, sf_dir), station_regions(spark, sf_dir))
    return area_totals(values, "station_id", ("region_id",), DAY)


@query
def station_fill_forward(spark, sf_dir):
    return fill_forward(daily_values(spark, sf_dir), ("station_id",), DAY)


@query
def time_weighted_availability(spark, sf_dir):
    rows = time_weighted(status(spark, sf_dir))
    return rows.withColumn("time_weighted", F.round("time_weighted", 6))


@query
def decode_props(spark, sf_dir):
    p = F.col("payload")
    events = table(spark, sf_dir, "events").select("event_id", decode.document(F.col("props")).alias("payload"))
    return events.select(
        "event_id",
        decode.field(p, "k", "int").alias("k"),
        decode.field(p, "k", "bigint").alias("k_long"),
        decode.field(p, "k", "string").alias("k_text"),
        decode.field(p, "missing", "int").alias("missing"),
        decode.undecodable(p, "k", "int").alias("bad"),
    )


def as_payloads(events: DataFrame) -> DataFrame:
    """Each event as the JSON object a feed would send, unknown fields and nested text included."""
    station = F.struct(
        F.col("user_id").cast("string").alias("station_id"),
        F.col("event_id").alias("legacy_id"),
        F.col("value").alias("num_bikes_available"),
        (F.col("event_type") != "error").alias("is_renting"),
        F.lit("from the feed").alias("ingested_at"),
        F.col("props").alias("extra"),
    )
    return events.select(
        F.col("user_id").cast("string").alias("station_id"),
        F.col("ts").cast("timestamp").alias("ingested_at"),
        decode.document(encode.json_text(station)).alias("payload"),
    )


@query
def published_status(spark, sf_dir):
    """Status records as keyed JSON messages, read back as typed events."""
    messages = status_messages(as_payloads(table(spark, sf_dir, "events")))
    received = messages.select(
        decode.text(F.col("key")).alias("key"), decode.text(F.col("value")).alias("value")
    )
    events = status_events(received.select("*", F.col("key").alias("message_key")))
    return events.select(
        "message_key",
        "station_id",
        F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"),
        "num_bikes_available",
        "is_renting",
        "num_ebikes_available",
        "legacy_id",
        decode.field(F.col("payload"), "extra", "string").alias("extra"),
    )


@query
def published_information(spark, sf_dir):
    """Station metadata as keyed JSON messages, read back as an upsert table."""
    supplier = table(spark, sf_dir, "supplier")
    payload = F.struct(
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("capacity"),
        F.col("s_nationkey").cast("string").alias("region_id"),
        F.struct(F.col("s_name").alias("web")).alias("rental_uris"),
    )
    rows = supplier.select(
        F.col("s_suppkey").cast("string").alias("station_id"),
        decode.document(encode.json_text(payload)).alias("payload"),
    )
    messages = information_messages(rows, "supplier", F.lit(1_704_067_200).cast("bigint"))
    received = messages.select(
        decode.text(F.col("key")).alias("key"), decode.text(F.col("value")).alias("value")
    )
    table_rows = station_information(received, ("_ingested_at",))
    return table_rows.withColumn("_ingested_at", F.col("_ingested_at").cast("timestamp_ntz"))


@query
def snapshot_records(spark, sf_dir):
    """Feed documents of two stations each, exploded and decoded."""
    events = table(spark, sf_dir, "events")
    one = F.struct(F.col("user_id").alias("station_id"), F.col("value").alias("num_bikes_available"))
    two = F.struct(
        F.col("event_type").alias("station_id"), F.col("event_id").cast("double").alias("num_bikes_available")
    )
    document = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("last_updated"),
        F.struct(F.array(encode.json_text(one), encode.json_text(two)).alias("texts")).alias("data"),
    )
    text = F.concat(
        F.lit('{"last_updated":'), document["last_updated"].cast("string"),
        F.lit(',"data":{"stations":['), F.array_join(document["data"]["texts"], ","), F.lit("]}}"),
    )
    documents = events.select("event_id", decode.document(text).alias("document"))
    documents = documents.withColumn("last_updated", decode.field(F.col("document"), "last_updated", "bigint"))
    counted = records.count_stations(documents)
    rows = records.decode_status(records.explode_stations(counted, strict=True))
    return rows.select("event_id", "last_updated", "stations", "pos", "station_id", "num_bikes_available")


@query
def rejects_split(spark, sf_dir):
    """Sign-ups lack their station and errors send text for a number; both are kept aside with the reason."""
    kind = F.col("event_type")
    station = F.when(kind != "signup", F.col("user_id").cast("string")).alias("station_id")
    sent = F.when(kind == "error", encode.json_text(F.struct(station, kind.alias("num_bikes_available")))).otherwise(
        encode.json_text(F.struct(station, F.col("value").alias("num_bikes_available")))
    )
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("pos"), decode.document(sent).alias("payload"))
    return records.delivery_counts(records.with_record_reason(rows))


def model_stations(spark, sf_dir) -> DataFrame:
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    return union_all(
        supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).alias("segment")),
        customer.select("c_custkey", "c_name", "c_mktsegment"),
    )


def model_segment(stations: DataFrame) -> DataFrame:
    return stations.where("segment = 'MACHINERY'")


@query
def model_union(spark, sf_dir):
    return model_stations(spark, sf_dir)


@query
def model_filter(spark, sf_dir):
    """Rows with a NULL segment are not equal to anything and fall out."""
    return model_segment(model_stations(spark, sf_dir))


@query
def dq_results(spark, sf_dir):
    stations = model_stations(spark, sf_dir)
    models = {
        "events": table(spark, sf_dir, "events"),
        "stations": stations,
        "segment": model_segment(stations),
    }
    both = ("unique", "not_null")
    tests = {
        "events": {"event_id": both, "user_id": both, "props": ("not_null",)},
        "stations": {"id": both, "segment": ("not_null",)},
        "segment": {"id": both},
    }
    return run_tests(spark, models, tests).unionByName(primary_key(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey"))


def layered(spark, sf_dir) -> tuple[Layers, DataFrame]:
    """A staging table of stations, a mart of their activity and a view of the busy ones, in databases of this run."""
    folder = run_dir(spark, "layers")
    number = folder.split("-")[-1].split("/")[0]
    layers = Layers(f"staging_{number}", f"marts_{number}", folder)
    layers.create(spark)

    def activity(ref) -> DataFrame:
        rows = status(spark, sf_dir).groupBy("station_id").agg(F.count("*").alias("n"), F.max("ingested_at").alias("last_seen"))
        return ref("stations").join(rows, F.col("key") == F.col("station_id"), "left").select("key", "name", "n", "last_seen")

    models = [
        Model(
            "stations",
            lambda ref: information(spark, sf_dir).select("key", "name", "capacity"),
            layer=layers.staging,
            descriptions={"key": "Identifies the station"},
            tests={"key": ("unique", "not_null"), "capacity": ("not_null",)},
        ),
        Model("activity", activity, layer=layers.marts, tests={"key": ("unique",), "last_seen": ("not_null", "unique")}),
        Model(f"busy_{number}", lambda ref: ref("activity").where("n > 50"), "view", tests={"n": ("not_null",)}),
    ]
    return layers, run_models(spark, models).withColumn("model", F.regexp_replace("model", f"_{number}$", ""))


@query
def mart_activity(spark, sf_dir):
    """The mart, read back from its table."""
    layers, _ = layered(spark, sf_dir)
    return spark.table(f"{layers.marts}.activity")


@query
def mart_tests(spark, sf_dir):
    """What the data tests of the layered models found."""
    return layered(spark, sf_dir)[1]


@query
def model_graph(spark, sf_dir):
    """Eight models given from the last to the first: they run as their references allow, and the last one is read back."""
    folder = run_dir(spark, "graph")
    number = folder.split("-")[-1].split("/")[0]
    layers = Layers(f"staging_{number}", f"marts_{number}", folder)
    layers.create(spark)

    def usage(ref) -> DataFrame:
        return usage_by_hour(ref("status")).groupBy("station_id").agg(F.sum("usage").alias("usage"))

    def stations(ref) -> DataFrame:
        return ref("information").join(ref("regions"), "key", "left").select("key", "capacity", "region_id")

    def activity(ref) -> DataFrame:
        joined = ref("stations").join(ref("usage"), F.col("key") == F.col("station_id"), "left")
        return joined.join(ref("seen"), "station_id", "left").select("key", "region_id", "capacity", "usage", "n")

    def summary(ref) -> DataFrame:
        return ref("activity").groupBy("region_id").agg(
            F.count("*").alias("stations"), F.sum("capacity").alias("capacity"), F.sum("usage").alias("usage"), F.sum("n").alias("n")
        )

    staging, marts = {"layer": layers.staging}, {"layer": layers.marts}
    models = [
        Model("summary", summary, **marts),
        Model("activity", activity, **marts),
        Model("seen", lambda ref: ref("status").groupBy("station_id").agg(F.count("*").alias("n")), **staging),
        Model("usage", usage, **staging),
        Model("stations", stations, **staging),
        Model("regions", lambda ref: station_regions(spark, sf_dir).select("key", "region_id"), **staging),
        Model("information", lambda ref: information(spark, sf_dir).select("key", "capacity"), **staging),
        Model("status", lambda ref: status(spark, sf_dir).select("station_id", *ORDER, "num_bikes_available"), **staging),
    ]
    return spark.table(materialize(spark, models).tables["summary"])


@query
def mart_increment(spark, sf_dir):
    """A mart that adds the new events to its own last version, in two runs; a third, whose tests fail, leaves it as it was."""
    folder = run_dir(spark, "increment")
    number = folder.split("-")[-1].split("/")[0]
    layers = Layers(f"staging_{number}", f"marts_{number}", folder)
    layers.create(spark)
    rows = status(spark, sf_dir).select("station_id", "pos")
    first, last = rows.agg(F.min("pos"), F.max("pos")).first()
    middle = (first + last) // 2 if first is not None else 0

    def seen(new: DataFrame) -> Model:
        def build(ref) -> DataFrame:
            counted = new.groupBy("station_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
            before = ref.last()
            rows = counted if before is None else counted.unionByName(before)
            return rows.groupBy("station_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

        return Model("seen", build, layer=layers.marts, tests={"station_id": ("unique", "not_null")}, guarded=True)

    unnamed = rows.withColumn("station_id", F.lit(None).cast("string"))
    materialize(spark, [seen(rows.where(F.col("pos") <= middle))])
    materialize(spark, [seen(rows.where(F.col("pos") > middle))])
    with contextlib.suppress(TestsFailed):
        materialize(spark, [seen(unnamed)])
    return spark.table(f"{layers.marts}.seen")


@query
def upper_name(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", F.upper("n_name").alias("name"), F.concat(F.lit("TRIP_"), F.upper("n_name")).alias("asset"))


@query
def orders_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    return latest(orders, "o_custkey", ("o_orderdate", "o_orderkey"))


@query
def orders_upsert_deletes(spark, sf_dir):
    """Customers whose last order is finished are deleted."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return latest(orders, "o_custkey", ("o_orderdate", "o_orderkey"), deleted=F.col("o_orderstatus") == "F")


def order_log(orders: DataFrame) -> DataFrame:
    """Orders as a metadata log: one key per customer, several writes within one second, deletes without any time.

    The order key is the position in the log; a customer whose last message is a delete vanishes.
    """
    payload = F.struct(
        F.col("o_orderkey").cast("string").alias("name"),
        F.col("o_totalprice").alias("capacity"),
        F.lit(1_704_067_200).alias("_ingested_at"),
    )
    return orders.select(
        F.col("o_custkey").cast("string").alias("key"),
        F.when(F.col("o_orderstatus") != "F", encode.json_text(payload)).alias("value"),
        F.col("o_orderkey").alias("position"),
    )


@query
def information_log_order(spark, sf_dir):
    """Writes and deletes of one second are decided by their place in the log."""
    return station_information(order_log(table(spark, sf_dir, "orders"))).select("key", "name", "capacity", "position")


@query
def stream_log_order(spark, sf_dir):
    """The same log as a stream: every customer of an order has a status, and its metadata as of the end of the log."""
    path = run_dir(spark, "stream_log_order")
    info = decode_information(order_log(stream(spark, sf_dir, "orders")))
    nothing = {n: F.lit(None).cast(t) for n, t in STATUS_FIELDS.items()}
    rows = stream(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("station_id"), F.lit(None).cast("timestamp").alias("ingested_at"), F.lit(0).alias("pos")
    )
    result = UpsertTable(f"{path}/table", ("station_id",))
    changes = current_status(rows.withColumns(nothing), info)
    drain(start(changes, result.write_batch, f"{path}/checkpoint", "update", every=None))
    return result.read(spark).select("station_id", "name", "capacity")


@query
def staged_tables(spark, sf_dir):
    """Tables named by a manifest, copied to staging and read back."""
    manifest = spark.createDataFrame(
        [("metadata", "supplier"), ("metadata", "nation"), ("status", "events"), ("other", "part")],
        "connection string, table_name string",
    )
    names = [r.table_name for r in selected_tables(manifest, ["metadata", "status"]).collect()]
    staging = run_dir(spark, "staging")
    load_tables(
        lambda name: table(spark, sf_dir, name),
        names,
        lambda rows, name: write_path(rows, f"{staging}/{asset_name('TRIP_DATA', name)}"),
    )
    counts = [
        spark.read.parquet(f"{staging}/{asset_name('TRIP_DATA', n)}").agg(F.count("*").alias("n")).select(
            F.lit(asset_name("TRIP_DATA", n)).alias("asset"), "n"
        )
        for n in names
    ]
    return union_all(*counts)


@query
def staged_increments(spark, sf_dir):
    """A table that grows between three runs, read in even ranges; the last run finds nothing new."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    ranges = even_ranges(orders.select("o_orderkey"), "o_orderkey", 4)
    source = union_all(*[orders.where(r) for r in ranges])
    early = orders.agg(F.percentile_approx("o_orderkey", 0.6)).first()[0]
    copies = Increments(f"{run_dir(spark, 'staged_increments')}/orders", "o_orderkey")
    for grown in (source.where(F.col("o_orderkey") <= early), source, source):
        copies.run(grown)
    return copies.read(spark)


def framed_events(events: DataFrame) -> DataFrame:
    """The events as framed messages: two versions of a schema, some of a third that nobody registered, some without a frame."""
    first = F.struct(F.col("user_id").alias("station"), F.col("value").alias("bikes"), F.col("event_type").alias("kind"))
    second = F.struct(
        F.struct(F.col("user_id").alias("id")).alias("station"), F.struct(F.col("value").alias("free")).alias("bikes"),
        F.col("ts").cast("string").alias("at"),
    )
    number = F.pmod(F.col("event_id"), F.lit(5))
    text = F.when(number == 0, encode.json_text(second)).otherwise(encode.json_text(first))
    head = F.when(number == 0, F.unhex(F.lit("0000000102"))).when(number == 4, F.unhex(F.lit("00000003E7"))).otherwise(
        F.unhex(F.lit("0000000101"))
    )
    body = encode.utf8(text)
    return events.select(
        F.col("event_id").alias("position"), F.when(number == 3, body).otherwise(F.concat(head, body)).alias("value")
    )


REGISTRY = {
    257: {"station_id": "station", "bikes": "bikes", "kind": "kind"},
    258: {"station_id": "station.id", "bikes": "bikes.free", "at": "at"},
}


@query
def schema_versions(spark, sf_dir):
    """A log of two schema versions decoded row by row; rows of others, and without a frame, have a reason."""
    fields = {"station_id": "string", "bikes": "int", "kind": "string", "at": "string"}
    rows = records.decode_by_schema(framed_events(table(spark, sf_dir, "events")), REGISTRY, fields)
    return rows.select("position", "schema_id", "station_id", "bikes", "kind", F.col("at").isNotNull().alias("timed"), "reject_reason")


@query
def stream_current(spark, sf_dir):
    """The updating join as a standing query over both logs."""
    path = run_dir(spark, "stream_current")
    rows = as_status(stream(spark, sf_dir, "events"))
    info = as_information(stream(spark, sf_dir, "supplier")).withColumns(
        {"_ingested_at": F.timestamp_seconds(F.lit(0)), "deleted": F.lit(False)}
    )
    result = UpsertTable(f"{path}/table", ("station_id",))
    drain(start(current_status(rows, info), result.write_batch, f"{path}/checkpoint", "update", every=None))
    return result.read(spark)


# A query that goes on until it is stopped, and takes what lands at once.
STANDING = "0 seconds"


def landing(
    spark,
    sf_dir,
    path: str,
    begin: Callable[[DataFrame], StreamingQuery],
    parts: int = 3,
    of: Callable[[int, int], Column] | None = None,
) -> None:
    """Let the events land in parts, cut at even times, while the query that ``begin`` starts over them runs; it has answered
    one part before the next one lands, so each part that has rows is a micro-batch.

    The parts are staged in one pass over the events, each in as many files as tasks can run, and moved in as whole folders.
    ``of`` gives the part of each event instead, from the first and last time (microseconds).
    """
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    width = (last - first) // parts + 1 if first is not None else 1
    part_of = F.floor((at - F.lit(first)) / width) if of is None else of(first, last)
    numbered = events.withColumn("batch", F.coalesce(part_of, F.lit(0)))
    # By id and time, which needs no sort of the rows, as dealing them out in turn does.
    numbered.repartition(spark.sparkContext.defaultParallelism, "event_id", "ts").write.partitionBy("batch").parquet(f"{path}/staged")
    staged = folders.numbered(spark, f"{path}/staged")
    if not staged:
        events.limit(0).write.parquet(f"{path}/staged/batch=0")
    query = None
    try:
        for part in staged or [0]:
            folders.move(spark, f"{path}/staged/batch={part}", f"{path}/landing/batch={part}")
            if query is None:
                reader = spark.readStream.schema(events.schema).option("recursiveFileLookup", True)
                query = begin(reader.parquet(f"{path}/landing"))
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()


@query
def served_low_stations(spark, sf_dir):
    """The newest answer to a question that is asked with every micro-batch."""
    path = run_dir(spark, "served_low_stations")
    info = as_information(stream(spark, sf_dir, "supplier")).withColumns(
        {"_ingested_at": F.timestamp_seconds(F.lit(0)), "deleted": F.lit(False)}
    )
    low = {"low": lambda now: low_availability(now, min_bikes=10, min_ratio=0.01)}
    landing(
        spark, sf_dir, path, lambda events: start_current_table(as_status(events), info, f"{path}/live", STANDING, low)[0]
    )
    served = answer(spark, f"{path}/live/serving", "low")
    return served.select("station_id", "name", "num_bikes_available", "capacity", "is_renting")


def live_usage(spark, sf_dir, name: str) -> LiveUsage:
    """Usage kept by a stream of three micro-batches."""
    path = run_dir(spark, name)
    live = LiveUsage(f"{path}/live")
    # A micro-batch is computed with all its columns, so what usage does not ask for is left undecoded here.
    used = (live.station, *live.order, live.value)
    landing(
        spark, sf_dir, path, lambda events: start(as_status(events).select(*used), live.process, f"{path}/checkpoint", every=STANDING)
    )
    return live


@query
def served_peak_hours(spark, sf_dir):
    """The busiest hours of each station as the stream keeps them."""
    peaks = live_usage(spark, sf_dir, "served_peak_hours").peaks.read(spark)
    return peaks.withColumn("hour", F.col("hour").cast("bigint"))


@query
def served_peak_hours_region(spark, sf_dir):
    """The busiest hours of each region, from the sums that the stream keeps per station and hour."""
    hours = live_usage(spark, sf_dir, "served_peak_hours_region").hours.read(spark)
    usage = with_region(hours, station_regions(spark, sf_dir))
    return peak_hours(usage, "region_id").withColumn("hour", F.col("hour").cast("bigint"))


@query
def stream_time_weighted(spark, sf_dir):
    """Time-weighted availability from the seconds that the stream adds up per station."""
    sums = live_usage(spark, sf_dir, "stream_time_weighted").times.read(spark)
    return mean_over_time(sums).withColumn("time_weighted", F.round("time_weighted", 6))


@query
def stream_area_carry_forward_5m(spark, sf_dir):
    """Totals of all stations per five minutes, windows without a row included, from a stream of three micro-batches."""
    path = run_dir(spark, "stream_area_carry_forward_5m")
    result = AreaTotals(f"{path}/totals")

    def begin(events: DataFrame) -> StreamingQuery:
        rows = as_status(events).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
        moved = moved_stream(rows, "station_id", "ingested_at", "num_bikes_available", "pos")
        return start(moved, result.write_batch, f"{path}/checkpoint", "update", every=STANDING)

    landing(spark, sf_dir, path, begin)
    return result.read(spark).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_current_changes(spark, sf_dir):
    """The current status table from its changelog: three micro-batches of inserts and updates, added up."""
    path = run_dir(spark, "stream_current_changes")
    info = as_information(stream(spark, sf_dir, "supplier")).withColumns(
        {"_ingested_at": F.timestamp_seconds(F.lit(0)), "deleted": F.lit(False)}
    )
    result = ChangelogTable(UpsertTable(f"{path}/table", ("station_id",)))

    def begin(events: DataFrame) -> StreamingQuery:
        return start(current_status(as_status(events), info), result.write_batch, f"{path}/checkpoint", "update", every=STANDING)

    landing(spark, sf_dir, path, begin)
    return folded(result.changes(spark))


@query
def stream_enriched(spark, sf_dir):
    """A status stream joined with the metadata as it stands."""
    path = run_dir(spark, "stream_enriched")
    rows = enrich(as_status(stream(spark, sf_dir, "events")), information(spark, sf_dir), lenient=True)
    drain(start(rows, parquet_publisher(f"{path}/rows"), f"{path}/checkpoint", every=None))
    return spark.read.parquet(f"{path}/rows").drop("batch")


@query
def stream_tumbling(spark, sf_dir):
    path = run_dir(spark, "stream_tumbling")
    rows = as_status(stream(spark, sf_dir, "events")).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    windows = tumbling_stream(rows, ("event_type",), "ingested_at", "num_bikes_available", ORDER)
    result = UpsertTable(f"{path}/table", ("event_type", "window_start"))
    drain(start(windows, result.write_batch, f"{path}/checkpoint", "update", every=None))
    return result.read(spark).withColumns(
        {"window_start": F.col("window_start").cast("timestamp_ntz"), "avg_value": F.round("avg_value", 6)}
    )


@query
def stream_poll_changes(spark, sf_dir):
    path = run_dir(spark, "stream_poll_changes")
    rows = daily_polls(as_status(stream(spark, sf_dir, "events")))
    process = ChangeFilter(f"{path}/states", parquet_publisher(f"{path}/changes"), ("event_type",)).process
    drain(start(rows, process, f"{path}/checkpoint", every=None))
    changes = spark.read.parquet(f"{path}/changes")
    return changes.select("station_id", F.col("ingested_at").cast("timestamp_ntz").alias("poll"), "pos", "event_type")


@query
def stream_poll_changes_batches(spark, sf_dir):
    """The change filter over several micro-batches, whose borders cut through polls."""
    path = run_dir(spark, "stream_poll_changes_batches")
    process = ChangeFilter(f"{path}/states", parquet_publisher(f"{path}/changes"), ("event_type",)).process
    landing(
        spark, sf_dir, path, lambda events: start(daily_polls(as_status(events)), process, f"{path}/checkpoint", every=STANDING)
    )
    changes = spark.read.parquet(f"{path}/changes")
    return changes.select("station_id", F.col("ingested_at").cast("timestamp_ntz").alias("poll"), "pos", "event_type")


LATE_DAYS = 15


@query
def stream_poll_changes_late(spark, sf_dir):
    """Daily polls that land up to two weeks late: of every 15 days, first each third one, then those before and after it."""
    path = run_dir(spark, "stream_poll_changes_late")
    day = F.unix_date(F.col("ts").cast("date"))

    def part(first: int, last: int) -> Column:
        since = day - first // 86_400_000_000
        return 3 * F.floor(since / LATE_DAYS) + F.pmod(2 * since, F.lit(3))

    first_day, last_day = table(spark, sf_dir, "events").agg(F.min(day), F.max(day)).first()
    parts = 3 * ((last_day - first_day) // LATE_DAYS + 1) if first_day is not None else 1
    step = CorrectingFilter(f"{path}/history", parquet_publisher(f"{path}/changes"), f"{LATE_DAYS} days", ("event_type",))

    def begin(events: DataFrame) -> StreamingQuery:
        return start(daily_polls(as_status(events)), step.process, f"{path}/checkpoint", every=STANDING)

    landing(spark, sf_dir, path, begin, parts, part)
    changes = folded(spark.read.parquet(f"{path}/changes"))
    return changes.select("station_id", F.col("ingested_at").cast("timestamp_ntz").alias("poll"), "pos", "event_type")
