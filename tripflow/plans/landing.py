"""Trip files, object events and stored trips made from the given tables.

The tables hold no trips, so the registered queries first write trip CSV from them. Everything is
written by Spark tasks into the shared folder, whole tables at a time, and read back from there.
"""

import os
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.plans.ingest import ingest_file
from tripflow.schema import DROPOFF, PICKUP, TRIP_SCHEMA
from tripflow.session import shared_dir
from tripflow.sinks import JdbcSink, ParquetSink
from tripflow.sources import JdbcTable
from tripflow.sources.files import child_names, exists

# Rows of a landed file, some 200 MB; a small table is cut into LANDING_FILES all the same, so that there are several.
FILE_ROWS = 1_000_000
LANDING_FILES = 4

CSV_TIME = "yyyy-MM-dd HH:mm:ss"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

T = TypeVar("T")
_made: dict[tuple, object] = {}


@dataclass(frozen=True)
class Landing:
    path: str
    files: int
    rows: int  # per file, at most

    @property
    def batch_files(self) -> int:
        """Files per trigger so that the stream takes a handful of batches however many files there are."""
        return max(1, -(-self.files // LANDING_FILES))


def new_landing(spark: SparkSession, source: DataFrame, name: str) -> Landing:
    """An empty directory for trips made from `source`."""
    # A bare count is answered from the parquet footers.
    count = source.count()
    rows = max(1, min(FILE_ROWS, -(-count // LANDING_FILES)))
    return Landing(shared_dir(spark, name), -(-count // rows), rows)


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """Make `name` for these tables the first time this application asks for it, or after it was deleted."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = getattr(_made.get(key), "path", None)
    if key not in _made or (path and not exists(spark, path)):
        _made[key] = make()
    return _made[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coordinate(degrees: int, identity: Column) -> Column:
    return F.concat(F.lit(f"{degrees}."), F.lpad(identity.cast("string"), 18, "0"))


def event_id(longitude: str = "pickup_longitude") -> Column:
    """The event a trip was made from: the digits of its pickup longitude."""
    return F.substring_index(F.col(longitude), ".", -1).cast("long")


def trips_from_events(events: DataFrame) -> DataFrame:
    """One trip per event: `event_id`, then the 19 columns as they stand in a file."""
    pickup = F.date_trunc("second", F.col("ts").cast("timestamp"))
    minutes = (F.col("user_id") * 7 % 90).cast("int")
    value, kind = F.col("value"), F.col("event_type")
    columns = {
        "VendorID": (F.col("event_id") % 2 + 1).cast("int"),
        PICKUP: pickup,
        DROPOFF: pickup + F.make_dt_interval(F.lit(0), F.lit(0), minutes),
        "passenger_count": (F.col("user_id") % 6).cast("int"),
        "trip_distance": value.cast("float"),
        "pickup_longitude": _coordinate(-73, F.col("event_id")),
        "pickup_latitude": _coordinate(40, F.col("user_id")),
        "RateCodeID": (F.col("user_id") % 6 + 1).cast("int"),
        "store_and_fwd_flag": F.when(kind == "error", "Y")
        .when(kind == "signup", "true")
        .when(kind == "view", "FALSE")
        .otherwise("N"),
        "dropoff_longitude": _coordinate(-74, F.col("user_id")),
        "dropoff_latitude": _coordinate(41, F.col("event_id")),
        "payment_type": F.array_position(F.array(*map(F.lit, EVENT_TYPES)), kind).cast("int"),
        "fare_amount": (value * 2.5).cast("float"),
        "extra": F.lit(0.5).cast("float"),
        "mta_tax": F.lit(0.5).cast("float"),
        "tip_amount": (value * 0.2).cast("float"),
        "tolls_amount": F.lit(0.0).cast("float"),
        "improvement_surcharge": F.lit(0.3).cast("float"),
        "total_amount": (value * 2.7).cast("float"),
    }
    return events.select("event_id", *(column.alias(name) for name, column in columns.items()))


def trips_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One trip per order line, the larger input."""
    seconds = F.col("l_orderkey") * 37 + F.col("l_linenumber") * 1009
    pickup = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(secs=(seconds % 86400).cast("decimal(18,6)"))
    ride = F.make_dt_interval(secs=(F.col("l_partkey") * 13 % 7200).cast("decimal(18,6)"))
    columns = {
        "VendorID": (F.col("l_linenumber") % 2 + 1).cast("int"),
        PICKUP: pickup,
        DROPOFF: pickup + ride,
        "passenger_count": F.col("l_linenumber"),
        "trip_distance": F.col("l_quantity").cast("float"),
        "pickup_longitude": _coordinate(-73, F.col("l_orderkey")),
        "pickup_latitude": _coordinate(40, F.col("l_partkey")),
        "RateCodeID": (F.col("l_suppkey") % 6 + 1).cast("int"),
        "store_and_fwd_flag": F.when(F.col("l_linestatus") == "F", "true").otherwise("false"),
        "dropoff_longitude": _coordinate(-74, F.col("l_suppkey")),
        "dropoff_latitude": _coordinate(41, F.col("l_linenumber")),
        "payment_type": F.when(F.col("l_returnflag") == "R", 2).otherwise(1),
        "fare_amount": F.col("l_extendedprice").cast("float"),
        "extra": F.col("l_discount").cast("float"),
        "mta_tax": F.lit(0.5).cast("float"),
        "tip_amount": F.col("l_tax").cast("float"),
        "tolls_amount": F.lit(0.0).cast("float"),
        "improvement_surcharge": F.lit(0.3).cast("float"),
        "total_amount": (F.col("l_extendedprice") * (1 + F.col("l_tax"))).cast("float"),
    }
    return lineitem.select(*(column.alias(name) for name, column in columns.items()))


def write_csv(trips: DataFrame, path: str, rows: int, *, by: str | None = None, extension: str = "csv") -> None:
    """Trip CSV below `path`, at most `rows` rows per file; one directory per value of `by` if given."""
    writer = trips.select(*([by] if by else []), *TRIP_SCHEMA.names).write
    writer = writer.options(header=True, timestampFormat=CSV_TIME, extension=extension, maxRecordsPerFile=rows)
    (writer.partitionBy(by) if by else writer).csv(path)


def event_landing(spark: SparkSession, sf_dir: str) -> Landing:
    """All trips made from `events`, split into files as the tasks come: no shuffle."""

    def make() -> Landing:
        events = table(spark, sf_dir, "events")
        landing = new_landing(spark, events, "landing")
        write_csv(trips_from_events(events), landing.path, landing.rows)
        return replace(landing, files=len(landed_files(spark, landing.path)))

    return once(spark, sf_dir, "event landing", make)


def lineitem_landing(spark: SparkSession, sf_dir: str) -> Landing:
    """All trips made from `lineitem`."""

    def make() -> Landing:
        lineitem = table(spark, sf_dir, "lineitem")
        landing = new_landing(spark, lineitem, "lineitem-landing")
        write_csv(trips_from_lineitem(lineitem), landing.path, landing.rows)
        return replace(landing, files=len(landed_files(spark, landing.path)))

    return once(spark, sf_dir, "lineitem landing", make)


def landed_files(spark: SparkSession, path: str) -> list[str]:
    return [f"{path}/{name}" for name in child_names(spark, path) if name.endswith(".csv")]


def numbered_trips(events: DataFrame, landing: Landing) -> DataFrame:
    """Trips with the number `f` of the file they go to, as many consecutive event ids as a file has rows.

    The shuffle puts file k into task k, so there are as many tasks as files; files are of equal size, so none is hot.
    """
    trips = trips_from_events(events).withColumn("f", F.floor(F.col("event_id") / landing.rows).cast("int"))
    return trips.repartitionById(landing.files, "f")


def numbered_landing(spark: SparkSession, sf_dir: str) -> Landing:
    """All trips made from `events`, one directory with one file for each file number."""

    def make() -> Landing:
        events = table(spark, sf_dir, "events")
        landing = new_landing(spark, events, "numbered")
        write_csv(numbered_trips(events, landing), landing.path, landing.rows, by="f")
        return landing

    return once(spark, sf_dir, "numbered landing", make)


def file_number(landing: Landing) -> Column:
    """`f` of a stored trip."""
    return F.floor(event_id() / landing.rows).alias("f")


def event_json(events: DataFrame) -> DataFrame:
    """One object-created event per row of `events`: `event_id`, `json`, in all the forms they come in."""
    bucket, key = F.concat(F.lit("b-"), F.col("event_type")), F.concat_ws("/", F.col("user_id"), F.col("event_id"))
    csv, txt = F.concat(key, F.lit(".csv")), F.concat(key, F.lit(".txt"))

    def ref(name: Column, object_key: Column) -> Column:
        return F.struct(
            F.struct(name.alias("name")).alias("bucket"), F.struct(object_key.alias("key")).alias("object")
        )

    def records(*keys: Column) -> Column:
        return F.array(*(F.struct(ref(bucket, k).alias("s3")) for k in keys)).alias("Records")

    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.to_json(F.struct(ref(bucket, csv).alias("detail"))))
        .when(kind == "purchase", F.to_json(F.struct(records(csv, txt))))
        .when(
            kind == "view",
            F.to_json(F.struct(F.struct(F.struct(bucket.alias("name")).alias("bucket")).alias("detail"), records(csv))),
        )
        .when(kind == "signup", F.lit("{}"))
        .otherwise(F.lit("notjson"))
    )
    return events.select("event_id", text.alias("json"))


def database_table(spark: SparkSession, name: str) -> JdbcTable:
    """The table `name` of the database in the environment.

    Without one, a local master gets Derby inside its own process, which no other process sees; on
    a cluster that could not work, so there it is an error.
    """
    if os.environ.get("DB_URL"):
        env = os.environ
        return JdbcTable(env["DB_URL"], name, env["DB_DRIVER"], env.get("DB_USER"), env.get("DB_PASSWORD"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("database queries need DB_URL and DB_DRIVER on a cluster")
    # Derby would leave a log file in whichever directory the JVM was started from.
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    return JdbcTable("jdbc:derby:memory:tripflow;create=true", name, "org.apache.derby.jdbc.EmbeddedDriver")


def stored_trips(spark: SparkSession, sf_dir: str) -> ParquetSink:
    """All trips made from `events`, ingested into parquet as batch 0."""

    def make() -> ParquetSink:
        sink = ParquetSink(shared_dir(spark, "stored"))
        ingest_file(spark, event_landing(spark, sf_dir).path, sink, 0)
        return sink

    return once(spark, sf_dir, "stored", make)


def stored_trips_in_database(spark: SparkSession, sf_dir: str, name: str) -> JdbcSink:
    """The same in a database table."""

    def make() -> JdbcSink:
        sink = JdbcSink(database_table(spark, name))
        ingest_file(spark, event_landing(spark, sf_dir).path, sink, 0, replace=True)
        return sink

    return once(spark, sf_dir, f"stored in {name}", make)
