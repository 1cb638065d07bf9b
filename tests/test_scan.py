"""CSV files under the declared schema."""

import datetime as dt

import pytest
from conftest import HEADER, land, trip
from pyspark.sql.types import StructType

from tripflow.operators import enrich_trips
from tripflow.plans import ingest_file
from tripflow.schema import ENRICHED_SCHEMA, STORED_SCHEMA, TRIP_SCHEMA
from tripflow.sources import read_trips_batch


def one(spark, path, row, header=HEADER, **options):
    land(path / "t.csv", row, header=header)
    return enrich_trips(read_trips_batch(spark, str(path), **options)).first()


def test_schemas():
    assert len(TRIP_SCHEMA) == 19 and len(ENRICHED_SCHEMA) == 21 and len(STORED_SCHEMA) == 22
    assert all(f.nullable for f in TRIP_SCHEMA)
    assert STORED_SCHEMA.names[-3:] == ["trip_Length", "day_of_week", "Id"]


def test_sample_row(spark, tmp_path):
    row = one(spark, tmp_path, trip())
    assert row.VendorID == 1 and row.total_amount == pytest.approx(17.05)
    assert row.tpep_pickup_datetime == dt.datetime(2015, 1, 15, 19, 5, 39)
    assert row.pickup_longitude == "-73.99"
    assert (row.trip_Length, row.day_of_week, row.store_and_fwd_flag) == (18.05, "Thu", None)


def test_enriched_schema(spark, tmp_path):
    land(tmp_path / "t.csv", trip())
    df = enrich_trips(read_trips_batch(spark, str(tmp_path)))
    assert StructType([f for f in df.schema]) == ENRICHED_SCHEMA


@pytest.mark.parametrize(
    ("column", "text", "value"),
    [
        ("store_and_fwd_flag", "Y", None),
        ("store_and_fwd_flag", "1", None),
        ("store_and_fwd_flag", "true", True),
        ("store_and_fwd_flag", "FALSE", False),
        ("passenger_count", "x", None),
        ("passenger_count", "1.0", None),
        ("passenger_count", "99999999999", None),
        ("passenger_count", "", None),
        ("fare_amount", "abc", None),
        ("tpep_pickup_datetime", "garbage", None),
        ("tpep_pickup_datetime", "2015-01-15", dt.datetime(2015, 1, 15)),
        ("tpep_pickup_datetime", "2015-01-15T20:05:39Z", dt.datetime(2015, 1, 15, 20, 5, 39)),
    ],
)
def test_coercion_keeps_the_row(spark, tmp_path, column, text, value):
    row = one(spark, tmp_path, trip(**{column: text}))
    assert row[column] == value
    assert row.dropoff_latitude == "40.75" and row.improvement_surcharge == pytest.approx(0.3)


def test_bad_pickup_leaves_derived_columns_null(spark, tmp_path):
    row = one(spark, tmp_path, trip(tpep_pickup_datetime="garbage"))
    assert row.trip_Length is None and row.day_of_week is None
    assert row.tpep_dropoff_datetime is not None


def test_bad_dropoff_leaves_the_day(spark, tmp_path):
    row = one(spark, tmp_path, trip(tpep_dropoff_datetime=""))
    assert row.trip_Length is None and row.day_of_week == "Thu"


@pytest.mark.parametrize(("zone", "minutes"), [("UTC", 120.0), ("America/New_York", 60.0)])
def test_times_are_read_in_the_zone_of_the_session(spark, tmp_path, zone, minutes):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = {"tpep_pickup_datetime": "2015-03-08 01:30:00", "tpep_dropoff_datetime": "2015-03-08 03:30:00"}
        row = one(spark, tmp_path, trip(**times))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.trip_Length, row.day_of_week) == (minutes, "Sun")


def test_short_and_long_rows(spark, tmp_path):
    land(tmp_path / "t.csv", ",".join(trip().split(",")[:3]), trip() + ",surplus")
    short, long = sorted(read_trips_batch(spark, str(tmp_path)).collect(), key=lambda r: r.passenger_count or 0)
    assert short.VendorID == 1 and short.trip_distance is None and short.total_amount is None
    assert long.total_amount == pytest.approx(17.05)


def test_columns_bind_by_position(spark, tmp_path):
    names = TRIP_SCHEMA.names
    header = ",".join([names[1], names[0], *names[2:]])
    row = one(spark, tmp_path, trip(), header=header)
    assert row.VendorID == 1


def test_strict_header(spark, tmp_path):
    names = TRIP_SCHEMA.names
    with pytest.raises(Exception, match="CSV header does not conform"):
        one(spark, tmp_path, trip(), header=",".join([names[1], names[0], *names[2:]]), strict_header=True)
    assert one(spark, tmp_path, trip(), strict_header=True).VendorID == 1


def test_unfinished_and_hidden_files_are_not_input(spark, tmp_path):
    for name in ("a.csv", "deep/er/b.CSV", "c.csv.part", "_d.csv", ".e.csv", "f.txt"):
        land(tmp_path / name, trip(pickup_longitude=name))
    read = {r.pickup_longitude for r in read_trips_batch(spark, str(tmp_path)).collect()}
    assert read == {"a.csv", "deep/er/b.CSV"}
    flat = read_trips_batch(spark, str(tmp_path), recursive=False)
    assert {r.pickup_longitude for r in flat.collect()} == {"a.csv"}


def test_named_objects_are_taken_as_they_are(spark, tmp_path):
    paths = [land(tmp_path / name, trip(pickup_longitude=name)) for name in ("a.csv", "b.data", "c.csv")]
    rows = ingest_file(spark, paths[:2]).collect()
    assert {r.pickup_longitude for r in rows} == {"a.csv", "b.data"}
    assert ingest_file(spark, paths[2]).first().trip_Length == 18.05


def test_scan_reads_only_needed_columns(spark, tmp_path):
    land(tmp_path / "t.csv", trip())
    df = enrich_trips(read_trips_batch(spark, str(tmp_path))).select("trip_Length").where("VendorID = 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<VendorID:int,tpep_pickup_datetime:timestamp,tpep_dropoff_datetime:timestamp>" in plan
    assert "EqualTo(VendorID,1)" in plan and "Exchange" not in plan
