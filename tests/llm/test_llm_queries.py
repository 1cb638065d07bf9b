"""Registered queries against their SQL, over whole tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from tripflow.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert driver.queries().items() >= QUERIES.items()
    assert "pipeline" in driver.queries()


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    oracle = connection.execute(ORACLE_SQL[name])
    columns = [c[0] for c in oracle.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(map(repr, oracle.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected and expected
