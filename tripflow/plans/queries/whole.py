"""Operators over the whole stored table: overlaps, order, running sums, and its comparison with the landed files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow import operators as op
from tripflow.plans import landing as land
from tripflow.plans.queries.runs import new_parquet
from tripflow.plans.queries.shapes import cents
from tripflow.schema import DROPOFF, PICKUP, TRIP_LENGTH, TRIP_SCHEMA
from tripflow.sources import read_trips_batch


def trip_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of trips of equal vendor, rate and payment that are under way at the same time, and for how long."""
    keys = ["VendorID", "RateCodeID", "payment_type"]
    stored = land.stored_trips(spark, sf_dir).read(spark).select(land.event_id().alias("event_id"), PICKUP, DROPOFF, *keys)
    pairs = op.join_overlapping(stored, stored, on=keys, start=PICKUP, end=DROPOFF)
    shared = F.unix_seconds(F.least(f"l.{DROPOFF}", f"r.{DROPOFF}")) - F.unix_seconds(F.greatest(f"l.{PICKUP}", f"r.{PICKUP}"))
    ids = F.col("l.event_id").alias("a"), F.col("r.event_id").alias("b")
    return pairs.where("l.event_id < r.event_id").select(*ids, shared.alias("seconds"))


def trip_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every stored trip by length, the longest first."""
    stored = land.stored_trips(spark, sf_dir).read(spark).select(land.event_id().alias("event_id"), TRIP_LENGTH)
    return op.with_global_number(stored, [F.desc(TRIP_LENGTH), "event_id"]).select("event_id", "number")


def running_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vendor's distance so far, trip by trip: two keys hold all rows."""
    stored = land.stored_trips(spark, sf_dir).read(spark)
    rows = stored.select("VendorID", PICKUP, land.event_id().alias("event_id"), cents("trip_distance").alias("cents"))
    summed = op.with_running_total(rows, ["VendorID"], [PICKUP, "event_id"], "cents", out="distance_cents")
    return summed.select("VendorID", "event_id", "distance_cents")


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table that has lost some landed trips and holds others twice: these are named, and no others."""
    landed = read_trips_batch(spark, land.event_landing(spark, sf_dir).path)
    sink = new_parquet(spark)
    enriched = op.enrich_trips(landed)
    lost, double = land.event_id() % 97 == 5, land.event_id() % 89 == 7
    sink.write(op.with_batch_id(enriched.where(~lost), 0), 0)
    sink.write(op.with_batch_id(enriched.where(double), 1), 1)
    found = op.reconcile(landed, sink.read(spark), TRIP_SCHEMA.names)
    return found.select(land.event_id().alias("event_id"), "landed", "stored")
