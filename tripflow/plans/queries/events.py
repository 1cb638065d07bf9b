"""Object-created events to object references."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow import operators as op
from tripflow.plans import landing as land
from tripflow.plans.queries.projections import MOUNT, PREFIX


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.normalize_object_events(land.event_json(land.table(spark, sf_dir, "events")), "json")


def event_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).select("event_id", "bucket", "key")


def event_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.split_valid_events(_normalized(spark, sf_dir))[0].select("event_id")


def event_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.split_valid_events(_normalized(spark, sf_dir))[1].select("event_id")


def event_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = land.event_json(land.table(spark, sf_dir, "events"))
    return op.explode_object_records(events, "json").select("event_id", "bucket", "key")


def event_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every CSV object that was announced, as the file to read and the file it lands in."""
    events = land.event_json(land.table(spark, sf_dir, "events"))
    refs = op.only_csv_objects(op.explode_object_records(events, "json"))
    return op.with_landing_path(op.with_object_uri(refs), MOUNT, PREFIX).select("event_id", "uri", "path")


def csv_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    suffix = F.when(kind == "error", ".CSV").when(kind == "click", ".csv").otherwise(".txt")
    key = F.concat(F.col("event_id").cast("string"), suffix)
    return op.only_csv_objects(land.table(spark, sf_dir, "events").select("event_id", key.alias("key")))
