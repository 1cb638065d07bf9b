import time

import pytest
from conftest import land, trip
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripflow import operators as op
from tripflow.operators.event_time import TOTALS
from tripflow.plans.queries import QUERIES
from tripflow.schema import STORED_SCHEMA
from tripflow.sinks import ParquetSink
from tripflow.sources import read_trips_batch, read_trips_stream
from tripflow.streaming import start_ingest, state_report

PICKUP, DROPOFF = "tpep_pickup_datetime", "tpep_dropoff_datetime"


def at(clock, **fields):
    return trip(**{PICKUP: f"2015-01-15 {clock}", DROPOFF: f"2015-01-15 {clock}"}, trip_distance="1.5", **fields)


class Stream:
    def __init__(self, spark, folder, make, schema):
        self.spark, self.folder, self.make = spark, folder, make
        self.sink = ParquetSink(str(folder / "sink"), schema)

    def drain(self):
        rows = self.make(read_trips_stream(self.spark, str(self.folder / "in"), max_files_per_trigger=None))
        query = start_ingest(rows, self.sink, str(self.folder / "checkpoint"), stateful=True)
        query.awaitTermination()
        return state_report(query)

    def rows(self):
        return self.sink.read(self.spark) if (self.folder / "sink").exists() else None


def shown(df):
    return sorted((str(r.window_start)[11:16], str(r.window_end)[11:16], r.n, r.distance_cents) for r in df.collect())


def windows(spark, tmp_path, make):
    schema = StructType.fromDDL(f"VendorID int, {TOTALS}, Id int")
    return Stream(spark, tmp_path, lambda trips: make(op.enrich_trips(trips)), schema)


def test_tumbling_and_late_rows(spark, tmp_path):
    stream = windows(spark, tmp_path, lambda t: op.tumbling_totals(t, "1 hour", delay="30 minutes"))
    land(tmp_path / "in" / "a.csv", at("10:05:00"), at("10:59:59"), at("11:00:00"), at("13:10:00"), trip(**{PICKUP: "x"}))
    stream.drain()
    # The watermark is 12:40: two windows are final, the third waits.
    assert shown(stream.rows()) == [("10:00", "11:00", 2, 300), ("11:00", "12:00", 1, 150)]
    land(tmp_path / "in" / "b.csv", at("11:59:00"), at("12:30:00"), at("13:00:00"), at("20:00:00"))
    report = stream.drain()
    assert report.late_rows == 1
    assert shown(stream.rows())[2:] == [("12:00", "13:00", 1, 150), ("13:00", "14:00", 2, 300)]
    assert report.rows == 1 and report.bytes > 0


def test_final_windows_are_stored_once_after_a_crash(spark, tmp_path):
    stream = windows(spark, tmp_path, lambda t: op.tumbling_totals(t, "1 hour", delay="0 seconds"))
    land(tmp_path / "in" / "a.csv", at("10:05:00"), at("12:10:00"))
    stream.drain()
    # The commits of the last two batches are lost: both are run again, from their states.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))
    for commit in commits[-1:]:
        commit.unlink()
        (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    stream.drain()
    assert shown(stream.rows()) == [("10:00", "11:00", 1, 150)]


@pytest.mark.parametrize(
    "make, expected",
    [
        (
            lambda t, **d: op.sliding_totals(t, "2 hours", "1 hour", **d),
            [("09:00", "11:00", 2, 300), ("10:00", "12:00", 3, 450), ("11:00", "13:00", 1, 150)],
        ),
        (lambda t, **d: op.session_totals(t, "20 minutes", **d), [("10:05", "10:45", 2, 300), ("11:00", "11:20", 1, 150)]),
    ],
)
def test_stream_equals_table(spark, tmp_path, make, expected):
    stream = windows(spark, tmp_path, lambda t: make(t, delay="0 seconds"))
    path = land(tmp_path / "in" / "a.csv", at("10:05:00"), at("10:25:00"), at("11:00:00"), trip(**{PICKUP: ""}))
    table = make(op.enrich_trips(read_trips_batch(spark, path)))
    assert shown(table) == expected and table.columns[0] == "VendorID"
    land(tmp_path / "in" / "b.csv", at("20:00:00"))
    stream.drain()
    assert shown(stream.rows()) == expected


def test_a_session_that_is_still_open(spark, tmp_path):
    """Trips without a gap: nothing is final, so nothing is stored, and the sink reads as empty."""
    stream = windows(spark, tmp_path, lambda t: op.session_totals(t, "20 minutes", delay="0 seconds"))
    land(tmp_path / "in" / "a.csv", at("10:05:00"), at("10:20:00"))
    stream.drain()
    assert stream.sink.read(spark).collect() == [] and stream.sink.read(spark).schema == stream.sink.schema
    assert stream.sink.count(spark).first().n == 0
    land(tmp_path / "in" / "b.csv", at("20:00:00"))
    stream.drain()
    assert shown(stream.sink.read(spark)) == [("10:05", "10:40", 2, 300)]


def test_sessions_of_dense_trips(spark, tmp_path):
    """The query, where no session ends before the end of time."""
    events = spark.range(600).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id DIV 12) AS ts", "id % 12 AS user_id",
        "'click' AS event_type", "1.5D AS value",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = QUERIES["window_session"](spark, str(tmp_path)).collect()
    assert sorted((r.window_start[11:], r.window_end[11:]) for r in rows) == [("00:00:00", "00:59:00")] * len(rows)
    assert sum(r.n for r in rows) == 600 and len(rows) == 6


def dedup(spark, tmp_path, within):
    return Stream(spark, tmp_path, lambda t: op.enrich_trips(op.drop_redelivered(t, within)), STORED_SCHEMA)


def test_redelivered_files(spark, tmp_path):
    stream = dedup(spark, tmp_path, "1 day")
    rows = [at("10:00:00"), at("10:00:00", tip_amount="9"), trip(**{PICKUP: "", DROPOFF: "", "extra": "x"}), trip(VendorID="")]
    land(tmp_path / "in" / "a.csv", *rows)
    stream.drain()
    land(tmp_path / "in" / "deep" / "b.csv", *reversed(rows))
    land(tmp_path / "in" / "c.csv", rows[0], at("09:00:00"))
    report = stream.drain()
    assert stream.rows().count() == 5 == report.rows and report.late_rows == 0
    assert stream.rows().schema == STORED_SCHEMA
    table = op.drop_redelivered(read_trips_batch(spark, str(tmp_path / "in")), "1 day")
    assert table.count() == 5


def test_state_of_old_arrivals_goes(spark, tmp_path):
    stream = dedup(spark, tmp_path, "1 second")
    land(tmp_path / "in" / "a.csv", at("10:00:00"), at("10:00:01"))
    assert stream.drain().rows == 2
    time.sleep(3)
    land(tmp_path / "in" / "b.csv", at("10:00:02"))
    assert stream.drain().rows == 1
    land(tmp_path / "in" / "c.csv", at("10:00:00"))
    stream.drain()
    # Beyond the time that is remembered a trip is taken again.
    assert stream.rows().count() == 4


def test_identity_tells_null_from_text(spark):
    names = ["VendorID", "pickup_longitude"]
    schema = StructType.fromDDL("VendorID int, pickup_longitude string")
    rows = [(1, None), (1, "null"), (1, ""), (None, None), (11, "1"), (1, "11")]
    table = spark.createDataFrame(rows, schema)
    assert table.select(op.trip_identity(schema).alias("i")).distinct().count() == len(rows)
    assert table.select(*names).columns == names


REFS = "bucket string, key string, announced_at timestamp"
ROWS = "bucket string, key string, arrived_at timestamp, n int"


def moments(spark, rows, schema):
    table = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
    at = "announced_at" if "announced" in schema else "arrived_at"
    return table.withColumn(at, F.concat(F.lit("2015-01-15 "), at).cast("timestamp"))


def joined(refs, rows):
    found = op.join_announced(
        refs, rows, announced_at="announced_at", arrived_at="arrived_at", within="1 hour", delay="10 minutes"
    )
    return found


def test_join_of_tables(spark):
    refs = [("b", "x", "10:00:00"), ("b", "y", "10:00:00"), ("c", "x", "10:00:00"), ("b", "z", "10:00:00"), ("b", "n", "10:00:00")]
    rows = [("b", "x", "10:00:00", 1), ("b", "x", "11:00:00", 2), ("b", "y", "11:00:01", 3), ("b", "z", "09:59:59", 4), ("d", "n", "10:01:00", 5)]
    found = joined(moments(spark, refs, REFS), moments(spark, rows, ROWS))
    assert found.columns == ["bucket", "key", "announced_at", "arrived_at", "n"]
    assert sorted((r.bucket, r.key, r.n or 0) for r in found.collect()) == [
        ("b", "n", 0), ("b", "x", 1), ("b", "x", 2), ("b", "y", 0), ("b", "z", 0), ("c", "x", 0)
    ]
    with pytest.raises(ValueError, match="both sides"):
        joined(moments(spark, refs, REFS).withColumn("n", F.lit(1)), moments(spark, rows, ROWS))


def test_unmatched_only_when_nothing_can_come(spark, tmp_path):
    """A reference is given out unmatched once both sides are past its hour."""

    def add(name, rows, schema):
        moments(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def drain():
        refs = spark.readStream.schema(REFS).parquet(str(tmp_path / "refs"))
        rows = spark.readStream.schema(ROWS).parquet(str(tmp_path / "rows"))
        query = start_ingest(joined(refs, rows), sink, str(tmp_path / "checkpoint"), stateful=True)
        query.awaitTermination()
        found = sink.read(spark).collect() if (tmp_path / "sink").exists() else []
        return sorted((r.key, r.n or 0) for r in found), state_report(query).rows

    schema = StructType.fromDDL("bucket string, key string, announced_at timestamp, arrived_at timestamp, n int, Id int")
    sink = ParquetSink(str(tmp_path / "sink"), schema)
    add("refs", [("b", "x", "10:00:00"), ("b", "y", "10:05:00")], REFS)
    add("rows", [("b", "x", "10:20:00", 1)], ROWS)
    assert drain()[0] == [("x", 1)]
    add("refs", [("b", "w", "13:00:00")], REFS)
    # The rows are still at 10:20, so the file of `y` may come.
    assert drain()[0] == [("x", 1)]
    add("rows", [("b", "y", "11:00:00", 2)], ROWS)
    assert drain()[0] == [("x", 1), ("y", 2)]
    add("refs", [("b", "v", "18:00:00")], REFS)
    add("rows", [("b", "v", "18:00:00", 3)], ROWS)
    found, state = drain()
    assert found == [("v", 3), ("w", 0), ("x", 1), ("y", 2)] and state <= 2
