"""The slate's queries in SQL for another engine, written independently of the operators (gaps are really filled, and
changes are found by looking the previous poll up)."""

from __future__ import annotations

STATUS = """status AS (
    SELECT 'events' AS feed, CAST(user_id AS VARCHAR) AS station_id, ts AS ingested_at, event_id AS pos, event_type,
           CAST(trunc(value) AS INTEGER) AS num_bikes_available,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS num_docks_available,
           CAST(NULL AS INTEGER) AS num_ebikes_available, CAST(NULL AS INTEGER) AS num_bikes_disabled,
           CAST(NULL AS INTEGER) AS num_docks_disabled, CAST(NULL AS INTEGER) AS num_scooters_available,
           CAST(NULL AS INTEGER) AS num_scooters_unavailable,
           CAST(event_type <> 'signup' AS INTEGER) AS is_installed,
           CAST(event_type <> 'error' AS INTEGER) AS is_renting,
           CAST(event_type <> 'view' AS INTEGER) AS is_returning,
           CAST(floor(epoch(ts)) AS BIGINT) AS last_reported,
           event_type = 'click' AS eightd_has_available_keys, CAST(event_id AS VARCHAR) AS legacy_id
    FROM events)"""

# Errors have lost their time, views their value, and all times are cut to the hour, so that many rows share one.
GAPS = """gaps AS (SELECT * EXCLUDE (ingested_at, num_bikes_available),
        CASE WHEN event_type <> 'error' THEN date_trunc('hour', ingested_at) END AS ingested_at,
        CASE WHEN event_type <> 'view' THEN num_bikes_available END AS num_bikes_available FROM status)"""

INFO = """info AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon,
           CAST(trunc(s_acctbal) AS INTEGER) AS capacity, upper(s_name) AS short_name FROM supplier)"""

LOG_ORDER = """ended AS (
    SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
    log AS (SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS name,
        CAST(trunc(o_totalprice) AS INTEGER) AS capacity, o_orderkey AS position FROM ended WHERE o_orderstatus <> 'F')"""

MART = """activity AS (SELECT key, name, count(station_id) AS n, max(ingested_at) AS last_seen
    FROM info LEFT JOIN status ON key = station_id GROUP BY key, name)"""

REGIONS = """regions AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS station_id, r_name AS region_id FROM supplier
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

CURRENT = """current AS (
    SELECT * FROM status QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ingested_at DESC, pos DESC) = 1)"""

COLUMNS = """station_id, name, lat, lon, ingested_at, eightd_has_available_keys, is_installed, is_renting, is_returning,
    last_reported, legacy_id, num_bikes_available, num_bikes_disabled, num_docks_available, num_docks_disabled,
    num_ebikes_available, num_scooters_available, num_scooters_unavailable, capacity, short_name"""

ENRICHED_CURRENT = f"WITH {STATUS}, {INFO}, {CURRENT} SELECT {COLUMNS} FROM current LEFT JOIN info ON station_id = key"
ENRICHED_LOG = f"WITH {STATUS}, {INFO} SELECT {COLUMNS} FROM status LEFT JOIN info ON station_id = key"


def _changes(state: str) -> str:
    return f"""r AS (SELECT station_id, CAST(date_trunc('day', ingested_at) AS TIMESTAMP) AS poll, pos, event_type,
        is_renting, {state} AS state FROM status),
    polls AS (SELECT poll, lag(poll) OVER (ORDER BY poll) AS before FROM (SELECT DISTINCT poll FROM r)),
    ended AS (SELECT station_id, poll, arg_max(state, pos) AS state FROM r GROUP BY station_id, poll),
    flagged AS (SELECT r.*, e.station_id IS NULL OR e.state IS DISTINCT FROM r.state AS changed
        FROM r JOIN polls USING (poll) LEFT JOIN ended e ON e.station_id = r.station_id AND e.poll = polls.before)"""


POLL_CHANGES = f"WITH {STATUS}, {_changes('event_type')} SELECT station_id, poll, pos, event_type FROM flagged WHERE changed"

USAGE = """steps AS (SELECT station_id, hour(ingested_at) AS hour, abs(num_bikes_available - lag(num_bikes_available)
        OVER (PARTITION BY station_id ORDER BY ingested_at NULLS FIRST, pos)) AS step FROM status
        WHERE num_bikes_available IS NOT NULL),
    usage AS (SELECT station_id, CAST(hour AS BIGINT) AS hour, CAST(sum(step) AS BIGINT) AS usage FROM steps
        WHERE step IS NOT NULL GROUP BY station_id, hour)"""


def _windows(key: str, interval: str) -> str:
    origin = "TIMESTAMP '2000-01-01'"
    return f"""windows AS (SELECT {key}, time_bucket(INTERVAL '{interval}', ingested_at, {origin}) AS window_start,
        count(*) AS n, min(num_bikes_available) AS min_value, max(num_bikes_available) AS max_value,
        round(avg(num_bikes_available), 6) AS avg_value, arg_min(num_bikes_available, row(ingested_at, pos)) AS first_value,
        arg_max(num_bikes_available, row(ingested_at, pos)) AS last_value,
        arg_max(num_bikes_available, row(ingested_at, pos)) - arg_min(num_bikes_available, row(ingested_at, pos)) AS change
        FROM status GROUP BY ALL)"""


def _previous(key: str) -> str:
    return f"last_value - lag(last_value) OVER (PARTITION BY {key} ORDER BY window_start) AS change_since_previous"


def _filled(interval: str) -> str:
    """Every station in every window of the grid, with its last known value."""
    step = f"INTERVAL '{interval}'"
    return f"""{_windows('station_id', interval)},
    grid AS (SELECT unnest(generate_series(min(window_start), max(window_start), {step})) AS window_start FROM windows),
    stations AS (SELECT DISTINCT station_id FROM windows),
    filled AS (SELECT s.station_id, g.window_start, last_value(w.last_value IGNORE NULLS) OVER (
        PARTITION BY s.station_id ORDER BY g.window_start ROWS UNBOUNDED PRECEDING) AS value
        FROM grid g CROSS JOIN stations s
        LEFT JOIN windows w ON w.station_id = s.station_id AND w.window_start = g.window_start)"""


def _area(interval: str) -> str:
    return f"""WITH {STATUS}, {_filled(interval)}
    SELECT window_start, CAST(sum(value) AS BIGINT) AS total FROM filled GROUP BY window_start"""


TUMBLING_5M = f"WITH {STATUS}, {_windows('event_type', '5 minutes')} SELECT * FROM windows"

STATIONS = """stations AS (SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer)"""


def _unique(model: str, source: str, column: str) -> str:
    return f"""SELECT '{model}' AS model, '{column}' AS "column", 'unique' AS test, count(*) AS failing_rows FROM (
        SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1)"""


def _not_null(model: str, source: str, column: str) -> str:
    return f"""SELECT '{model}' AS model, '{column}' AS "column", 'not_null' AS test, count(*) AS failing_rows
        FROM {source} WHERE {column} IS NULL"""


DQ = " UNION ALL ".join(
    test(*where)
    for where, tests in {
        ("events", "events", "event_id"): (_unique, _not_null),
        ("events", "events", "user_id"): (_unique, _not_null),
        ("events", "events", "props"): (_not_null,),
        ("stations", "stations", "id"): (_unique, _not_null),
        ("stations", "stations", "segment"): (_not_null,),
        ("segment", "(SELECT * FROM stations WHERE segment = 'MACHINERY')", "id"): (_unique, _not_null),
        ("supplier", "supplier", "s_suppkey"): (_unique, _not_null),
    }.items()
    for test in tests
)

LAST_ORDER = "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"

LOW_STATIONS = f"""WITH {STATUS}, {INFO}, {CURRENT}
    SELECT station_id, name, num_bikes_available, capacity, is_renting
    FROM current LEFT JOIN info ON station_id = key
    WHERE is_renting = 1
      AND (num_bikes_available <= 10 OR num_bikes_available / CAST(nullif(capacity, 0) AS DOUBLE) <= 0.01)"""

PEAK_HOURS = f"""WITH {STATUS}, {USAGE} SELECT *,
    CAST(row_number() OVER (PARTITION BY station_id ORDER BY usage DESC, hour) AS INTEGER) AS rank
    FROM usage QUALIFY rank <= 3"""

PEAK_HOURS_REGION = f"""WITH {STATUS}, {USAGE}, {REGIONS},
    r AS (SELECT region_id, hour, CAST(sum(usage) AS BIGINT) AS usage FROM usage LEFT JOIN regions USING (station_id)
          GROUP BY region_id, hour)
    SELECT *, CAST(row_number() OVER (PARTITION BY region_id ORDER BY usage DESC, hour) AS INTEGER) AS rank
    FROM r QUALIFY rank <= 3"""

TIME_WEIGHTED = f"""WITH {STATUS},
        held AS (SELECT station_id, num_bikes_available AS v, date_sub('second', ingested_at,
            lead(ingested_at) OVER (PARTITION BY station_id ORDER BY ingested_at, pos)) AS s FROM status),
        t AS (SELECT station_id, CAST(sum(v * s) AS BIGINT) AS value_seconds, CAST(sum(s) AS BIGINT) AS seconds
              FROM held GROUP BY station_id)
        SELECT *, round(CAST(value_seconds AS DOUBLE) / nullif(seconds, 0), 6) AS time_weighted FROM t"""

ORACLE: dict[str, str] = {
    "latest_status": f"""WITH {STATUS}, {CURRENT} SELECT station_id, ingested_at, pos, event_type, num_bikes_available,
        num_docks_available FROM current""",
    "enriched_current": ENRICHED_CURRENT,
    "enriched_log": ENRICHED_LOG,
    "low_stations": LOW_STATIONS,
    "served_low_stations": LOW_STATIONS,
    "poll_changes": POLL_CHANGES,
    "poll_change_counts": f"""WITH {STATUS}, {_changes("event_type || '/' || CAST(is_renting AS VARCHAR)")}
        SELECT poll, CAST(sum(CAST(changed AS INTEGER)) AS BIGINT) AS changed, count(*) AS total
        FROM flagged GROUP BY poll""",
    "peak_hours_station": PEAK_HOURS,
    "served_peak_hours": PEAK_HOURS,
    "peak_hours_region": PEAK_HOURS_REGION,
    "served_peak_hours_region": PEAK_HOURS_REGION,
    "usage_with_gaps": f"""WITH {STATUS}, {GAPS}, {USAGE.replace('FROM status', 'FROM gaps')} SELECT * FROM usage""",
    "tumbling_5m": TUMBLING_5M,
    "tumbling_5m_station": f"""WITH {STATUS}, {_windows('station_id', '5 minutes')}
        SELECT *, {_previous('station_id')} FROM windows""",
    "window_delta": f"""WITH {STATUS}, {_windows('station_id', '1 day')}
        SELECT station_id, window_start, last_value, {_previous('station_id')} FROM windows""",
    "area_carry_forward": _area("1 day"),
    "area_carry_forward_5m": _area("5 minutes"),
    "stream_area_carry_forward_5m": _area("5 minutes"),
    "region_carry_forward": f"""WITH {STATUS}, {REGIONS}, {_filled('1 day')}
        SELECT region_id, window_start, CAST(sum(value) AS BIGINT) AS total
        FROM filled LEFT JOIN regions USING (station_id) WHERE value IS NOT NULL GROUP BY region_id, window_start""",
    "station_fill_forward": f"""WITH {STATUS}, {_filled('1 day')}
        SELECT f.station_id, f.window_start, f.value FROM filled f
        JOIN (SELECT station_id, max(window_start) AS until FROM windows GROUP BY station_id) u USING (station_id)
        WHERE f.value IS NOT NULL AND f.window_start <= u.until""",
    "time_weighted_availability": TIME_WEIGHTED,
    "stream_time_weighted": TIME_WEIGHTED,
    "decode_props": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_long, json_extract_string(props, '$.k') AS k_text,
        CAST(json_extract_string(props, '$.missing') AS INTEGER) AS missing, false AS bad FROM events""",
    "published_status": """SELECT CAST(user_id AS VARCHAR) AS message_key, CAST(user_id AS VARCHAR) AS station_id,
        ts AS ingested_at, CAST(trunc(value) AS INTEGER) AS num_bikes_available,
        CAST(event_type <> 'error' AS INTEGER) AS is_renting, CAST(NULL AS INTEGER) AS num_ebikes_available,
        CAST(event_id AS VARCHAR) AS legacy_id, props AS extra FROM events""",
    "published_information": """SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, CAST(NULL AS DOUBLE) AS lat,
        CAST(NULL AS DOUBLE) AS lon, CAST(trunc(s_acctbal) AS INTEGER) AS capacity, CAST(NULL AS VARCHAR) AS short_name,
        CAST(s_nationkey AS VARCHAR) AS region_id, '{"web":"' || s_name || '"}' AS rental_uris,
        TIMESTAMP '2024-01-01' AS _ingested_at, 'supplier' AS _source FROM supplier""",
    "snapshot_records": """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS last_updated,
            CAST(2 AS INTEGER) AS stations, CAST(0 AS INTEGER) AS pos, CAST(user_id AS VARCHAR) AS station_id,
            CAST(trunc(value) AS INTEGER) AS num_bikes_available FROM events
        UNION ALL SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT), 2, 1, event_type, CAST(event_id AS INTEGER) FROM events""",
    "rejects_split": """SELECT CASE WHEN event_type = 'signup' THEN 'no station_id'
            WHEN event_type = 'error' THEN 'cannot read num_bikes_available as int' END AS reject_reason, count(*) AS n
        FROM events GROUP BY 1""",
    "model_union": f"WITH {STATIONS} SELECT * FROM stations",
    "model_filter": f"WITH {STATIONS} SELECT * FROM stations WHERE segment = 'MACHINERY'",
    "dq_results": f"WITH {STATIONS} {DQ}",
    "model_graph": f"""WITH {STATUS}, {REGIONS}, {USAGE},
        used AS (SELECT station_id, CAST(sum(usage) AS BIGINT) AS usage FROM usage GROUP BY station_id),
        seen AS (SELECT station_id, count(*) AS n FROM status GROUP BY station_id),
        places AS (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, CAST(trunc(s_acctbal) AS INTEGER) AS capacity FROM supplier)
        SELECT region_id, count(*) AS stations, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(usage) AS BIGINT) AS usage,
            CAST(sum(n) AS BIGINT) AS n
        FROM places LEFT JOIN regions USING (station_id) LEFT JOIN used USING (station_id) LEFT JOIN seen USING (station_id)
        GROUP BY region_id""",
    "upper_name": "SELECT n_nationkey, upper(n_name) AS name, 'TRIP_' || upper(n_name) AS asset FROM nation",
    "orders_upsert": f"SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, o_orderstatus FROM orders {LAST_ORDER}",
    "orders_upsert_deletes": f"""SELECT * FROM (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders
        {LAST_ORDER}) WHERE o_orderstatus <> 'F'""",
    "staged_tables": """SELECT 'TRIP_DATA_SUPPLIER' AS asset, count(*) AS n FROM supplier
        UNION ALL SELECT 'TRIP_DATA_NATION', count(*) FROM nation
        UNION ALL SELECT 'TRIP_DATA_EVENTS', count(*) FROM events""",
    "staged_increments": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
    "schema_versions": """SELECT event_id AS position,
        CAST(CASE event_id % 5 WHEN 0 THEN 258 WHEN 3 THEN NULL WHEN 4 THEN 999 ELSE 257 END AS BIGINT)
            AS schema_id,
        CASE WHEN event_id % 5 < 3 THEN CAST(user_id AS VARCHAR) END AS station_id,
        CASE WHEN event_id % 5 < 3 THEN CAST(trunc(value) AS INTEGER) END AS bikes,
        CASE WHEN event_id % 5 IN (1, 2) THEN event_type END AS kind, event_id % 5 = 0 AS timed,
        CASE event_id % 5 WHEN 3 THEN 'no frame' WHEN 4 THEN 'unknown schema 999' END AS reject_reason FROM events""",
    "mart_increment": f"""WITH {STATUS} SELECT station_id, CAST(count(*) AS BIGINT) AS n, max(pos) AS "last" FROM status
        GROUP BY station_id""",
    "information_log_order": f"WITH {LOG_ORDER} SELECT * FROM log",
    "stream_log_order": f"""WITH {LOG_ORDER} SELECT CAST(c_custkey AS VARCHAR) AS station_id, name, capacity
        FROM customer LEFT JOIN log ON key = CAST(c_custkey AS VARCHAR)""",
    "stream_current": ENRICHED_CURRENT,
    "stream_current_changes": ENRICHED_CURRENT,
    "stream_enriched": ENRICHED_LOG,
    "stream_tumbling": TUMBLING_5M,
    "stream_poll_changes": POLL_CHANGES,
    "stream_poll_changes_batches": POLL_CHANGES,
    "stream_poll_changes_late": POLL_CHANGES,
    "mart_activity": f"WITH {STATUS}, {INFO}, {MART} SELECT * FROM activity",
    "mart_tests": f"""WITH {STATUS}, {INFO}, {MART}
        SELECT 'stations' AS model, 'key' AS "column", 'unique' AS test, count(*) AS failing_rows
            FROM (SELECT key FROM info WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1)
        UNION ALL SELECT 'stations', 'key', 'not_null', count(*) FROM info WHERE key IS NULL
        UNION ALL SELECT 'stations', 'capacity', 'not_null', count(*) FROM info WHERE capacity IS NULL
        UNION ALL SELECT 'activity', 'key', 'unique', count(*) FROM (SELECT key FROM activity GROUP BY key HAVING count(*) > 1)
        UNION ALL SELECT 'activity', 'last_seen', 'not_null', count(*) FROM activity WHERE last_seen IS NULL
        UNION ALL SELECT 'activity', 'last_seen', 'unique', count(*) FROM (SELECT last_seen FROM activity
            WHERE last_seen IS NOT NULL GROUP BY last_seen HAVING count(*) > 1)
        UNION ALL SELECT 'busy', 'n', 'not_null', count(*) FROM activity WHERE n > 50 AND n IS NULL""",
}
