"""Every registered query against its SQL, over whole tables."""

import shutil
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from tripflow.plans import landing
from tripflow.plans.oracles import ORACLE_SQL
from tripflow.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([row[i] for i in order]) for row in values)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert driver.queries().items() >= QUERIES.items()
    assert driver.oracle_sql().items() >= ORACLE_SQL.items()


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    oracle = duck.execute(ORACLE_SQL[name])
    described = {column[0]: str(column[1]) for column in oracle.description}
    assert {column: TYPES[kind] for column, kind in df.dtypes} == described
    expected = rows(list(described), oracle.fetchall())
    assert rows(df.columns, df.collect()) == expected and expected


def test_entry(spark):
    assert sorted(r.day_of_week for r in driver.entry(spark).collect()) == sorted(
        "Mon Tue Wed Thu Fri Sat Sun".split()
    )


def test_files_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(landing, "FILE_ROWS", 100)
    events = landing.table(spark, SF_DIR, "events")
    made = landing.new_landing(spark, events, "many")
    assert (made.files, made.rows) == (-(-events.count() // 100), 100)
    trips = landing.numbered_trips(events, made)
    assert trips.rdd.getNumPartitions() == made.files
    landing.write_csv(trips, made.path, made.rows, by="f")
    assert spark.read.csv(made.path, header=True).groupBy("f").count().where("count <> 100").count() <= 1


def test_deleted_landing_is_made_again(spark):
    first = landing.event_landing(spark, SF_DIR)
    assert landing.event_landing(spark, SF_DIR) == first
    shutil.rmtree(first.path)
    second = landing.event_landing(spark, SF_DIR)
    assert second.path != first.path and driver.queries()["csv_scan"](spark, SF_DIR).count() > 0
