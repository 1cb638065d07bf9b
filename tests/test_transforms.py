"""Derived trip columns."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tripflow import operators as op

TS = "start timestamp, end timestamp"


def at(text):
    return dt.datetime.fromisoformat(text) if text else None


@pytest.mark.parametrize(
    ("start", "end", "minutes"),
    [
        ("2015-01-15 19:05:39", "2015-01-15 19:23:42", 18.05),
        ("2015-01-15 19:05:39.900", "2015-01-15 19:06:00.100", 0.35),
        ("2015-01-15 19:05:39", "2015-01-15 18:05:39", -60.0),
        ("2015-01-15 19:05:39", "2015-01-15 19:05:39", 0.0),
        ("2015-03-08 01:30:00", "2015-03-08 03:30:00", 120.0),
        (None, "2015-01-15 19:05:39", None),
        ("2015-01-15 19:05:39", None, None),
    ],
)
def test_trip_length(spark, start, end, minutes):
    df = spark.createDataFrame([(at(start), at(end))], TS)
    assert op.with_trip_length(df, "start", "end").first().trip_Length == minutes


def test_trip_length_takes_wall_clock_times(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2015-01-15 19:05:39' AS a, TIMESTAMP_NTZ'2015-01-15 19:06:39' AS b")
    assert op.with_trip_length(df, "a", "b", "m").first().m == 1.0


instants = st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2100, 1, 1))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(instants, instants), min_size=1, max_size=50))
def test_derived_columns_against_python(spark, pairs):
    df = spark.createDataFrame(pairs, TS)
    df = op.with_day_of_week(op.with_trip_length(df, "start", "end", "m"), "start", "d")

    def seconds(t):
        return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1)

    expected = sorted((s, e, (seconds(e) - seconds(s)) / 60, s.strftime("%a")) for s, e in pairs)
    assert sorted(map(tuple, df.collect())) == expected


@pytest.mark.parametrize("day", range(7))
def test_day_of_week(spark, day):
    ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)  # a Monday
    df = spark.createDataFrame([(ts,)], "ts timestamp")
    assert op.with_day_of_week(df, "ts").first().day_of_week == "Mon Tue Wed Thu Fri Sat Sun".split()[day]


def test_zone_of_the_session_decides(spark):
    df = spark.sql("SELECT timestamp'2015-03-08 01:30:00 UTC' AS ts")
    assert op.with_day_of_week(df, "ts").first().day_of_week == "Sun"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert op.with_day_of_week(df, "ts").first().day_of_week == "Sat"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_batch_id_is_an_int_column(spark):
    df = op.with_batch_id(spark.range(2), 7)
    assert df.dtypes[-1] == ("Id", "int") and {r.Id for r in df.collect()} == {7}


def test_derivation_is_one_projection(spark):
    df = spark.createDataFrame([(None, None)], "tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp")
    plan = op.with_batch_id(op.enrich_trips(df), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1
