"""Derived columns, each by itself."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow import operators as op
from tripflow.plans import landing as land
from tripflow.schema import DAY_OF_WEEK, TRIP_LENGTH

# Where objects land.
MOUNT, PREFIX = "/mnt/efs", "incoming"


def trip_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = land.trips_from_events(land.table(spark, sf_dir, "events"))
    return op.with_trip_length(trips).select("event_id", TRIP_LENGTH)


def trip_length_subsecond(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = land.table(spark, sf_dir, "events")
    since = events.select("event_id", "ts", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("start"))
    return op.with_trip_length(since, "start", "ts", "m").select("event_id", "m")


def day_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_day_of_week(land.table(spark, sf_dir, "events"), "ts").select("event_id", DAY_OF_WEEK)


def batch_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_batch_id(land.table(spark, sf_dir, "events").select("event_id"), 7)


def _object_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("event_id").cast("string"), F.lit(".csv"))
    return land.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("bucket"), key.alias("key"))


def object_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_object_uri(_object_refs(spark, sf_dir), out="p").select("event_id", "p")


def landing_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _object_refs(spark, sf_dir).withColumn("key", F.concat_ws("/", "bucket", "key"))
    return op.with_landing_path(refs, MOUNT, PREFIX, out="p", partial_out="part").select("event_id", "p", "part")
