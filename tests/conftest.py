import itertools
import os

import pytest
from pyspark.sql import SparkSession

from tripflow.schema import TRIP_SCHEMA
from tripflow.session import pin_settings
from tripflow.sources import JdbcTable

HEADER = ",".join(TRIP_SCHEMA.names)
ROW = (
    "1,2015-01-15 19:05:39,2015-01-15 19:23:42,1,1.59,-73.99,40.75,1,N,-73.97,40.75,1,"
    "12,1,0.5,3.25,0,0.3,17.05"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tripflow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    session._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    yield pin_settings(session)
    session.stop()


def trip(**fields: str) -> str:
    """The sample row with some fields replaced."""
    values = dict(zip(TRIP_SCHEMA.names, ROW.split(","), strict=True)) | fields
    return ",".join(values.values())


_clock = itertools.count(1_600_000_000)


def land(path, *rows: str, header: str = HEADER) -> str:
    """Write a CSV file that is newer than all landed before; returns its path."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *rows]) + "\n")
    mtime = next(_clock)
    os.utime(path, (mtime, mtime))
    return str(path)


_tables = itertools.count()


@pytest.fixture
def table() -> JdbcTable:
    """A new table in a database inside this process."""
    return JdbcTable(
        "jdbc:derby:memory:tests;create=true",
        f"trips_{next(_tables)}",
        "org.apache.derby.jdbc.EmbeddedDriver",
        max_connections=4,
    )
