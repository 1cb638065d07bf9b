"""DuckDB SQL over the given tables for each registered query, under the same key."""

_CSV_TIME = "%Y-%m-%d %H:%M:%S"


def _text(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), 'NULL')"


def _real(expression: str) -> str:
    """A 32-bit float, seen as a double."""
    return f"CAST(CAST({expression} AS REAL) AS DOUBLE)"


def _coordinate(degrees: int, identity: str) -> str:
    return f"'{degrees}.' || lpad(CAST({identity} AS VARCHAR), 18, '0')"


_MINUTES = "(user_id * 7 % 90)"

# Trips as files hold them: pickup and dropoff to the second, the other columns as text or number.
_TRIPS = f"""
WITH trips AS (SELECT event_id, event_type,
  date_trunc('second', ts) AS pu,
  date_trunc('second', ts) + to_minutes({_MINUTES}) AS dof,
  CASE event_type WHEN 'error' THEN 'Y' WHEN 'signup' THEN 'true' WHEN 'view' THEN 'FALSE' ELSE 'N' END AS flag,
  CAST(event_id % 2 + 1 AS INTEGER) AS VendorID,
  CAST(user_id % 6 AS INTEGER) AS passenger_count,
  {_real("value")} AS trip_distance,
  {_coordinate(-73, "event_id")} AS pickup_longitude,
  {_coordinate(40, "user_id")} AS pickup_latitude,
  CAST(user_id % 6 + 1 AS INTEGER) AS RateCodeID,
  {_coordinate(-74, "user_id")} AS dropoff_longitude,
  {_coordinate(41, "event_id")} AS dropoff_latitude,
  CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INTEGER) AS payment_type,
  {_real("value * 2.5::DOUBLE")} AS fare_amount,
  {_real("0.5")} AS extra,
  {_real("0.5")} AS mta_tax,
  {_real("value * 0.2::DOUBLE")} AS tip_amount,
  {_real("0.0")} AS tolls_amount,
  {_real("0.3")} AS improvement_surcharge,
  {_real("value * 2.7::DOUBLE")} AS total_amount
FROM events)
"""

_FLAG = "CASE WHEN lower(flag) IN ('true', 'false') THEN lower(flag) ELSE 'NULL' END"
_LENGTH = "CAST(epoch(dof) - epoch(pu) AS DOUBLE) / 60"


def _input_columns(**replaced: str) -> str:
    """The 19 columns in the types the queries show them in."""
    columns = {
        "VendorID": _text("VendorID"),
        "tpep_pickup_datetime": f"strftime(pu, '{_CSV_TIME}')",
        "tpep_dropoff_datetime": f"strftime(dof, '{_CSV_TIME}')",
        "passenger_count": _text("passenger_count"),
        "trip_distance": "trip_distance",
        "pickup_longitude": "pickup_longitude",
        "pickup_latitude": "pickup_latitude",
        "RateCodeID": _text("RateCodeID"),
        "store_and_fwd_flag": _FLAG,
        "dropoff_longitude": "dropoff_longitude",
        "dropoff_latitude": "dropoff_latitude",
        "payment_type": _text("payment_type"),
        "fare_amount": "fare_amount",
        "extra": "extra",
        "mta_tax": "mta_tax",
        "tip_amount": "tip_amount",
        "tolls_amount": "tolls_amount",
        "improvement_surcharge": "improvement_surcharge",
        "total_amount": "total_amount",
    }
    return ", ".join(f"{sql} AS {name}" for name, sql in (columns | replaced).items())


_DERIVED = f"""{_LENGTH} AS "trip_Length", strftime(pu, '%a') AS day_of_week"""
_STORED = f"""{_TRIPS} SELECT {_input_columns()}, {_DERIVED}, CAST(0 AS INTEGER) AS "Id" FROM trips"""

_SHORT = "event_type = 'view'"
_CUT_TEXT = f"CASE WHEN {_SHORT} THEN 'NULL' ELSE {{}} END"
_CUT_NUMBER = f"CASE WHEN {_SHORT} THEN -1.0 ELSE {{}} END"

# `view` rows end after ten fields and start on a bare date, `purchase` rows have one field too many.
_ROUGH = f"""{_TRIPS}, rough AS (
  SELECT * REPLACE (
    CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN date_trunc('day', pu) ELSE pu END AS pu,
    CASE WHEN event_type = 'click' THEN passenger_count END AS passenger_count,
    CASE WHEN event_type = 'error' THEN -1.0 ELSE trip_distance END AS trip_distance)
  FROM trips)
SELECT {_input_columns(
    tpep_pickup_datetime=_text(f"strftime(pu, '{_CSV_TIME}')"),
    dropoff_latitude=_CUT_TEXT.format("dropoff_latitude"),
    payment_type=_CUT_TEXT.format("CAST(payment_type AS VARCHAR)"),
    **{name: _CUT_NUMBER.format(name) for name in (
        "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount")},
)}, coalesce({_LENGTH}, -1.0) AS "trip_Length", coalesce(strftime(pu, '%a'), 'NULL') AS day_of_week FROM rough"""


def _by_day(keys: str = "") -> str:
    return f"""
SELECT {f"{keys}, " if keys else ""}strftime(ts, '%a') AS day_of_week, count(*) AS n,
  sum(CAST({_MINUTES} AS DOUBLE)) AS minutes,
  CAST(sum(CAST(round({_real("value")} * 100) AS BIGINT)) AS BIGINT) AS distance_cents
FROM events GROUP BY ALL"""


_FILE_ROWS = "(SELECT least(greatest((count(*) + 3) // 4, 1), 1000000) FROM events)"
_PER_FILE = f"SELECT event_id // {_FILE_ROWS} AS f, count(*) AS n, CAST(1 AS BIGINT) AS batches FROM events GROUP BY 1"

_NAMES_OBJECT = "event_type IN ('click', 'purchase', 'view')"
_KEY = "CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR)"
_RECORDS = """events, (VALUES ('.csv'), ('.txt')) v(x)
WHERE event_type = 'purchase' OR (event_type = 'view' AND x = '.csv')"""

_LINE_RIDE = "l_partkey * 13 % 7200"
_LINE_PICKUP = "l_shipdate + to_seconds((l_orderkey * 37 + l_linenumber * 1009) % 86400)"

# Held-back trips count in the windows that end after the watermark: the last pickup of the others less two days.
_TIMED = f"""{_TRIPS}, kept AS (SELECT *, {_LENGTH} AS minutes, CAST(round(trip_distance * 100) AS BIGINT) AS cents FROM trips),
mark AS (SELECT max(pu) - INTERVAL 2 DAY AS horizon FROM trips WHERE event_id % 10 <> 0)"""


def _in_windows(starts: str, hours: int) -> str:
    """Totals of windows; `starts` are the starts of those that hold `pu`."""
    return f"""{_TIMED}, placed AS (SELECT *, unnest({starts}) AS ws FROM kept),
counted AS (SELECT *, ws + INTERVAL {hours} HOUR AS we FROM placed)
SELECT "VendorID", strftime(ws, '{_CSV_TIME}') AS window_start, strftime(we, '{_CSV_TIME}') AS window_end,
  count(*) AS n, sum(minutes) AS minutes, CAST(sum(cents) AS BIGINT) AS distance_cents
FROM counted, mark WHERE event_id % 10 <> 0 OR we > horizon GROUP BY "VendorID", ws, we"""


_TWO_HOURS = "time_bucket(INTERVAL 2 HOUR, pu, TIMESTAMP '1970-01-01')"
_SESSIONS = f"""{_TIMED}, opened AS (SELECT *, pu > lag(pu) OVER same + INTERVAL 10 MINUTE AS opens FROM kept
  WINDOW same AS (PARTITION BY "VendorID", "RateCodeID" ORDER BY pu)),
numbered AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER
  (PARTITION BY "VendorID", "RateCodeID" ORDER BY pu) AS session FROM opened)
SELECT "VendorID", "RateCodeID", strftime(min(pu), '{_CSV_TIME}') AS window_start,
  strftime(max(pu) + INTERVAL 10 MINUTE, '{_CSV_TIME}') AS window_end,
  count(*) AS n, sum(minutes) AS minutes, CAST(sum(cents) AS BIGINT) AS distance_cents
FROM numbered GROUP BY "VendorID", "RateCodeID", session"""

_COME = f"event_id % 7 <> 0 AND {_MINUTES} <= 60"

ORACLE_SQL: dict[str, str] = {
    "trip_length": f"""{_TRIPS} SELECT event_id, {_LENGTH} AS "trip_Length" FROM trips""",
    "trip_length_subsecond": "SELECT event_id, (floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 60 AS m "
    "FROM events",
    "day_of_week": "SELECT event_id, strftime(ts, '%a') AS day_of_week FROM events",
    "batch_stamp": 'SELECT event_id, CAST(7 AS INTEGER) AS "Id" FROM events',
    "object_uri": "SELECT event_id, 's3a://' || event_type || '/' || CAST(event_id AS VARCHAR) || '.csv' AS p "
    "FROM events",
    "landing_path": "SELECT event_id, '/mnt/efs/incoming/' || event_type || '/' || CAST(event_id AS VARCHAR) || '.csv' "
    "AS p, p || '.part' AS part FROM events",
    "event_normalize": f"SELECT event_id, CASE WHEN {_NAMES_OBJECT} THEN 'b-' || event_type END AS bucket, "
    f"CASE WHEN {_NAMES_OBJECT} THEN {_KEY} || '.csv' END AS key FROM events",
    "event_valid": f"SELECT event_id FROM events WHERE {_NAMES_OBJECT}",
    "event_rejected": "SELECT event_id FROM events WHERE event_type IN ('signup', 'error')",
    "event_explode": f"SELECT event_id, 'b-' || event_type AS bucket, {_KEY} || x AS key FROM {_RECORDS}",
    "event_manifest": f"SELECT event_id, 's3a://b-' || event_type || '/' || {_KEY} || '.csv' AS uri, "
    f"'/mnt/efs/incoming/' || {_KEY} || '.csv' AS path FROM events WHERE event_type IN ('purchase', 'view')",
    "csv_key_filter": "SELECT * FROM (SELECT event_id, CAST(event_id AS VARCHAR) || CASE event_type "
    "WHEN 'error' THEN '.CSV' WHEN 'click' THEN '.csv' ELSE '.txt' END AS key FROM events) "
    "WHERE lower(key) LIKE '%.csv'",
    "csv_scan": f"{_TRIPS} SELECT {_input_columns()} FROM trips",
    "csv_coercion": _ROUGH,
    "batch_ingest": f"{_TRIPS} SELECT {_input_columns()}, {_DERIVED} FROM trips",
    "lineitem_ingest": f"""
SELECT CAST(l_linenumber % 2 + 1 AS INTEGER) AS "VendorID", strftime({_LINE_PICKUP}, '%a') AS day_of_week,
  count(*) AS n, CAST(sum({_LINE_RIDE}) AS BIGINT) AS seconds,
  CAST(sum(CAST(round({_real("l_extendedprice")} * 100) AS BIGINT)) AS BIGINT) AS fare_cents,
  count(*) FILTER (WHERE l_linestatus = 'F') AS stored_and_forwarded
FROM lineitem GROUP BY ALL""",
    "stream_ingest": _by_day(),
    "stream_update_mode": _by_day(),
    "stream_replay": _by_day(),
    "batch_row_counts": "SELECT count(*) AS reported, count(*) AS stored, CAST(0 AS BIGINT) AS batches_off FROM events",
    "stream_file_per_batch": _PER_FILE,
    "stream_batch_ids": f"SELECT count(DISTINCT event_id // {_FILE_ROWS}) AS batches, CAST(0 AS INTEGER) AS first_id, "
    f"CAST(max(event_id) // {_FILE_ROWS} AS INTEGER) AS last_id, CAST(1 AS BIGINT) AS files_per_batch FROM events",
    "stream_resume": _PER_FILE,
    "stream_visibility": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS decoys FROM events",
    "stream_empty_file": "SELECT count(*) AS n, CAST(1 AS INTEGER) AS first_id, CAST(1 AS INTEGER) AS empty_batches "
    "FROM events",
    "stream_compaction": f"SELECT *, CAST(0 AS INTEGER) AS small_directories FROM ({_by_day()})",
    "stream_sketches": "SELECT count(*) AS n, count(DISTINCT user_id) AS users, CAST(1 AS INTEGER) AS users_within, "
    "CAST(1 AS INTEGER) AS quantiles_within FROM events",
    "window_tumbling": _in_windows("[date_trunc('hour', pu)]", 1),
    "window_sliding": _in_windows(f"[{_TWO_HOURS} - to_hours(k) FOR k IN [0, 2, 4]]", 6),
    "window_session": _SESSIONS,
    "stream_dedup": f"SELECT *, (SELECT count(*) FROM events) AS state_rows FROM ({_by_day()})",
    "announced_join": f"SELECT event_id, 'b-' || event_type AS bucket, {_KEY} || '.csv' AS key, "
    f"CASE WHEN {_COME} THEN 1 ELSE 0 END AS came, CASE WHEN {_COME} THEN {_real('value')} ELSE -1.0::DOUBLE END "
    f"AS trip_distance FROM events WHERE {_NAMES_OBJECT}",
    "trip_overlaps": f"""{_TRIPS} SELECT a.event_id AS a, b.event_id AS b,
  CAST(epoch(least(a.dof, b.dof)) - epoch(greatest(a.pu, b.pu)) AS BIGINT) AS seconds FROM trips a JOIN trips b
ON a.event_id < b.event_id AND a."VendorID" = b."VendorID" AND a."RateCodeID" = b."RateCodeID"
  AND a.payment_type = b.payment_type AND a.pu < b.dof AND b.pu < a.dof AND a.pu < a.dof AND b.pu < b.dof""",
    "trip_numbers": f"""{_TRIPS} SELECT event_id, row_number() OVER (ORDER BY {_LENGTH} DESC, event_id) AS number FROM trips""",
    "running_distance": f"""{_TRIPS} SELECT "VendorID", event_id, CAST(sum(CAST(round(trip_distance * 100) AS BIGINT))
  OVER (PARTITION BY "VendorID" ORDER BY pu, event_id) AS BIGINT) AS distance_cents FROM trips""",
    "reconciliation": "SELECT event_id, CAST(1 AS BIGINT) AS landed, CAST(CASE WHEN event_id % 97 = 5 THEN 0 ELSE 1 END + "
    "CASE WHEN event_id % 89 = 7 THEN 1 ELSE 0 END AS BIGINT) AS stored FROM events "
    "WHERE (event_id % 97 = 5) <> (event_id % 89 = 7)",
    "parquet_replace": _by_day('CAST(event_id % 2 AS INTEGER) AS "Id"'),
    "stream_resume_same_ids": "SELECT count(*) AS n, count(*) AS trips, CAST(0 AS INTEGER) AS first_id FROM events",
    "object_empty_file": "SELECT count(*) AS n, CAST(-1 AS INTEGER) AS id, CAST(1 AS INTEGER) AS empty_objects, "
    "count(*) AS reported FROM events",
    "parquet_readback": _STORED,
    "row_count": "SELECT count(*) AS n FROM events",
    "preview10": f"""{_TRIPS} SELECT event_id, {_DERIVED}, CAST(0 AS INTEGER) AS "Id" FROM trips
ORDER BY event_id LIMIT 10""",
    "jdbc_append": _by_day('CAST(event_id % 2 AS INTEGER) AS "Id"'),
    "stream_ingest_jdbc": _by_day(),
    "stream_replay_jdbc": _by_day(),
    "sink_readback": _STORED,
    "jdbc_row_count": "SELECT count(*) AS n FROM events",
    "jdbc_preview10": f"""{_TRIPS} SELECT event_id, {_DERIVED}, CAST(0 AS INTEGER) AS "Id" FROM trips
ORDER BY pu, dof, trip_distance LIMIT 10""",
}
