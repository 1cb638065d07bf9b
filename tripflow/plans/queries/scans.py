"""CSV files read as a batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow import operators as op
from tripflow.plans import landing as land
from tripflow.plans.ingest import ingest_file
from tripflow.plans.queries.shapes import cents, derived_columns, trip_columns
from tripflow.schema import BATCH_ID, DAY_OF_WEEK, DROPOFF, PICKUP, TRIP_LENGTH, TRIP_SCHEMA
from tripflow.session import shared_dir
from tripflow.sinks import ParquetSink
from tripflow.sources import read_trips_batch
from tripflow.sources.files import write_text


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_trips_batch(spark, land.event_landing(spark, sf_dir).path).select(*trip_columns())


def rough_landing(spark: SparkSession, sf_dir: str) -> land.Landing:
    """Lines with fields that do not parse, too few fields or too many."""

    def make() -> land.Landing:
        events = land.table(spark, sf_dir, "events")
        landing, trips = land.new_landing(spark, events, "rough"), land.trips_from_events(events)
        kind = F.element_at(F.array(*map(F.lit, land.EVENT_TYPES)), F.col("payment_type"))
        pickup = F.date_format(PICKUP, land.CSV_TIME)
        rough = {
            PICKUP: F.when(kind == "signup", "garbage")
            .when(kind == "view", F.substring(pickup, 1, 10))
            .when(kind == "purchase", F.concat(F.translate(pickup, " ", "T"), F.lit("Z")))
            .otherwise(pickup),
            DROPOFF: F.date_format(DROPOFF, land.CSV_TIME),
            "passenger_count": F.when(kind == "error", "x")
            .when(kind == "signup", "1.0")
            .when(kind == "view", "99999999999")
            .when(kind == "purchase", "")
            .otherwise(F.col("passenger_count").cast("string")),
            "trip_distance": F.when(kind == "error", "abc").otherwise(F.col("trip_distance").cast("string")),
        }
        fields = F.array(*(rough.get(name, F.col(name).cast("string")) for name in TRIP_SCHEMA.names))
        fields = F.when(kind == "view", F.slice(fields, 1, 10)).when(
            kind == "purchase", F.array_append(fields, F.lit("surplus"))
        ).otherwise(fields)
        trips.select(F.concat_ws(",", fields)).write.text(landing.path)
        return landing

    return land.once(spark, sf_dir, "rough", make)


def csv_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that do not parse, rows that are too short or too long: NULL there, the rest kept."""
    landing = rough_landing(spark, sf_dir)
    trips = op.enrich_trips(read_trips_batch(spark, landing.path, path_glob=None, header=False))
    return trips.select(*trip_columns(), *derived_columns())


def batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = ingest_file(spark, land.event_landing(spark, sf_dir).path)
    return trips.select(*trip_columns(), *derived_columns())


def object_empty_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named object with only a header stores nothing and takes no id; the next one may have it."""
    path, sink = shared_dir(spark, "header-only"), ParquetSink(shared_dir(spark, "sink"))
    write_text(spark, f"{path}/empty.csv", ",".join(TRIP_SCHEMA.names) + "\n")
    objects = (f"{path}/empty.csv", land.event_landing(spark, sf_dir).path)
    reports = [ingest_file(spark, path, sink, -1) for path in objects]
    return sink.read(spark).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(BATCH_ID).alias("id"),
        F.lit(sum(r.stored_as is None for r in reports)).alias("empty_objects"),
        F.lit(sum(r.rows for r in reports)).cast("long").alias("reported"),
    )


def lineitem_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger input: scan, derive and summarise."""
    trips = op.enrich_trips(read_trips_batch(spark, land.lineitem_landing(spark, sf_dir).path))
    return trips.groupBy("VendorID", DAY_OF_WEEK).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col(TRIP_LENGTH) * 60).cast("long")).alias("seconds"),
        F.sum(cents("fare_amount")).alias("fare_cents"),
        F.count(F.when(F.col("store_and_fwd_flag"), 1)).alias("stored_and_forwarded"),
    )
