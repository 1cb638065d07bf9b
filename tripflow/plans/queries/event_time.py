"""Stateful streams: windows, redelivered files, announced objects."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripflow import operators as op
from tripflow.operators.event_time import TOTALS, WINDOW_END, WINDOW_START
from tripflow.plans import landing as land
from tripflow.plans.queries.shapes import by_day
from tripflow.plans.queries.streams import HEADER
from tripflow.schema import BATCH_ID, DROPOFF, PICKUP, STORED_SCHEMA, TRIP_SCHEMA
from tripflow.session import shared_dir
from tripflow.sinks import ParquetSink
from tripflow.sources import read_trips_stream
from tripflow.sources.files import write_text
from tripflow.streaming import StateReport, start_ingest, state_report

# Every tenth event is held back until all others have been read.
HELD_BACK = 10
DELAY = "2 days"
# Later than any time in the tables: moves the watermark past all of them.
FAR = "2100-01-01 00:00:00"


@dataclass
class _Stream:
    """A stateful stream over a landing directory, run once or more often."""

    spark: SparkSession
    rows: Callable[[], DataFrame]
    schema: StructType
    states: list[StateReport] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.sink = ParquetSink(shared_dir(self.spark, "sink"), self.schema)
        self.checkpoint = shared_dir(self.spark, "checkpoint")

    def drain(self) -> DataFrame:
        query = start_ingest(self.rows(), self.sink, self.checkpoint, stateful=True)
        query.awaitTermination()
        self.states.append(state_report(query))
        return self.sink.read(self.spark)


def _stored(columns: str) -> StructType:
    return StructType.fromDDL(f"{columns}, {BATCH_ID} int")


def _flush_file(spark: SparkSession, path: str) -> None:
    """A file with one trip at FAR, of no vendor."""
    trip = dict.fromkeys(TRIP_SCHEMA.names, "") | {PICKUP: FAR, DROPOFF: FAR}
    write_text(spark, path, HEADER + ",".join(trip.values()) + "\n")


def _windows(spark: SparkSession, sf_dir: str, windowed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All trips but those held back, then these, of which those for final windows are late; then the end of time."""
    events = land.table(spark, sf_dir, "events")
    landing = land.new_landing(spark, events, "windows")

    def rows() -> DataFrame:
        return windowed(op.enrich_trips(read_trips_stream(spark, landing.path, max_files_per_trigger=None)))

    stream = _Stream(spark, rows, _stored(f"VendorID int, {TOTALS}"))
    held = F.col("event_id") % HELD_BACK == 0
    for name, wave in (("on-time", events.where(~held)), ("held-back", events.where(held))):
        land.write_csv(land.trips_from_events(wave), f"{landing.path}/{name}", landing.rows)
        stream.drain()
    _flush_file(spark, f"{landing.path}/flush.csv")
    shown = [F.date_format(name, land.CSV_TIME).alias(name) for name in (WINDOW_START, WINDOW_END)]
    return stream.drain().where("VendorID IS NOT NULL").select("VendorID", *shown, "n", "minutes", "distance_cents")


def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, lambda trips: op.tumbling_totals(trips, "1 hour", delay=DELAY))


def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, lambda trips: op.sliding_totals(trips, "6 hours", "2 hours", delay=DELAY))


def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each vendor, over all trips: none is held back, as a late one may end up within a final session."""
    events = land.table(spark, sf_dir, "events")
    landing = land.new_landing(spark, events, "sessions")

    def rows() -> DataFrame:
        trips = op.enrich_trips(read_trips_stream(spark, landing.path, max_files_per_trigger=None))
        return op.session_totals(trips, "10 minutes", delay=DELAY, keys=["VendorID", "RateCodeID"])

    stream = _Stream(spark, rows, _stored(f"VendorID int, RateCodeID int, {TOTALS}"))
    for wave in (0, 1):
        part = events.where(F.col("event_id") % 2 == wave)
        land.write_csv(land.trips_from_events(part), f"{landing.path}/wave{wave}", landing.rows)
    stream.drain()
    _flush_file(spark, f"{landing.path}/flush.csv")
    shown = [F.date_format(name, land.CSV_TIME).alias(name) for name in (WINDOW_START, WINDOW_END)]
    rows = stream.drain().where("VendorID IS NOT NULL")
    return rows.select("VendorID", "RateCodeID", *shown, "n", "minutes", "distance_cents")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files, then all of them again under other paths; the state holds each trip once."""
    events = land.table(spark, sf_dir, "events")
    landing = land.new_landing(spark, events, "redelivered")

    def rows() -> DataFrame:
        trips = read_trips_stream(spark, landing.path, max_files_per_trigger=None)
        return op.enrich_trips(op.drop_redelivered(trips, "30 days"))

    stream = _Stream(spark, rows, STORED_SCHEMA)
    for name in ("first", "again"):
        land.write_csv(land.trips_from_events(events), f"{landing.path}/{name}", landing.rows)
        stored = stream.drain()
    return by_day(stored).withColumn("state_rows", F.lit(stream.states[-1].rows).cast("long"))


def announced_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object events with the trips of the objects they announce, which come up to an hour later, too late, or never."""
    events = land.table(spark, sf_dir, "events")
    landing = land.new_landing(spark, events, "arrivals")
    announced = shared_dir(spark, "announcements")
    stamped = land.event_json(events).join(events.select("event_id", "ts"), "event_id")
    at = F.date_trunc("second", F.col("ts").cast("timestamp")).alias("announced_at")
    stamped.select("event_id", "json", at).write.parquet(f"{announced}/all")
    came = events.where(F.col("event_id") % 7 != 0)
    land.write_csv(land.trips_from_events(came), f"{landing.path}/all", landing.rows)

    def rows() -> DataFrame:
        messages = spark.readStream.schema("event_id long, json string, announced_at timestamp")
        messages = messages.option("recursiveFileLookup", True).parquet(announced)
        refs = op.split_valid_events(op.normalize_object_events(messages, "json"))[0].drop("json")
        trips = op.enrich_trips(read_trips_stream(spark, landing.path, max_files_per_trigger=None))
        user = F.substring_index("pickup_latitude", ".", -1).cast("long")
        names = {
            "bucket": F.concat(F.lit("b-"), F.element_at(F.array(*map(F.lit, land.EVENT_TYPES)), F.col("payment_type"))),
            "key": F.concat_ws("/", user, F.concat(land.event_id(), F.lit(".csv"))),
        }
        arrived = trips.select(F.col(DROPOFF).alias("arrived_at"), "trip_distance", *(c.alias(n) for n, c in names.items()))
        return op.join_announced(
            refs, arrived, announced_at="announced_at", arrived_at="arrived_at", within="1 hour", delay="30 days"
        )

    columns = "event_id long, announced_at timestamp, bucket string, key string, arrived_at timestamp, trip_distance float"
    stream = _Stream(spark, rows, _stored(columns))
    stream.drain()
    # Both sides must move on before a reference counts as unmatched.
    _flush_file(spark, f"{landing.path}/flush.csv")
    detail = F.lit('{"detail":{"bucket":{"name":"none"},"object":{"key":"none"}}}')
    last = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), detail.alias("json"), F.lit(FAR).cast("timestamp").alias("announced_at"))
    last.write.parquet(f"{announced}/last")
    stored = stream.drain().where("event_id >= 0")
    distance = F.coalesce(F.col("trip_distance").cast("double"), F.lit(-1.0)).alias("trip_distance")
    return stored.select("event_id", "bucket", "key", F.col("arrived_at").isNotNull().cast("int").alias("came"), distance)

