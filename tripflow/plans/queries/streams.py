"""CSV files read as a stream."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.plans import landing as land
from tripflow.plans.queries.runs import Run, crash_and_resume, new_parquet, new_table, run_over_events
from tripflow.plans.queries.shapes import by_day
from tripflow.schema import BATCH_ID, DROPOFF, PICKUP, TRIP_LENGTH, TRIP_SCHEMA
from tripflow.sinks import ParquetSink, compact, estimates, sketch_batches, vacuum
from tripflow.sinks.sketches import DISTINCT_ERROR, RANK_ERROR
from tripflow.sources.files import write_text


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_over_events(spark, sf_dir)
    run.drain()
    return by_day(run.sink.read(spark))


def stream_update_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_over_events(spark, sf_dir, output_mode="update")
    run.drain()
    return by_day(run.sink.read(spark))


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_over_events(spark, sf_dir)
    crash_and_resume(run)
    return by_day(run.sink.read(spark))


def stream_resume_same_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch lost after its write: a restart with another first id is refused, the right one stores each trip once."""
    run = run_over_events(spark, sf_dir)
    crash_and_resume(run, refused_id=100)
    return run.sink.read(spark).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pickup_longitude").alias("trips"), F.min(BATCH_ID).alias("first_id")
    )


def batch_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer reported for each batch against what the sink holds for it."""
    run = run_over_events(spark, sf_dir)
    run.drain()
    reported = spark.createDataFrame(
        [(r.stored_as, r.rows) for r in run.reports if r.stored_as is not None], f"{BATCH_ID} int, reported long"
    )
    stored = run.sink.read(spark).groupBy(BATCH_ID).agg(F.count(F.lit(1)).alias("stored"))
    both = reported.join(stored, BATCH_ID, "full")
    return both.agg(
        F.sum("reported").alias("reported"),
        F.sum("stored").alias("stored"),
        F.count(F.when(~F.col("reported").eqNullSafe(F.col("stored")), 1)).alias("batches_off"),
    )


def _batches_per_file(stored: DataFrame, landing: land.Landing) -> DataFrame:
    return stored.groupBy(land.file_number(landing)).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(BATCH_ID).alias("batches")
    )


def _one_file_batches(spark: SparkSession, sf_dir: str) -> tuple[land.Landing, ParquetSink]:
    landing = land.numbered_landing(spark, sf_dir)
    run = Run(spark, landing.path, new_parquet(spark), max_files=1)
    run.drain()
    return landing, run.sink


def stream_file_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per micro-batch: no file is split over batches."""
    landing, sink = _one_file_batches(spark, sf_dir)
    return _batches_per_file(sink.read(spark), landing)


def stream_batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch ids count up from 0, one per file."""
    landing, sink = _one_file_batches(spark, sf_dir)
    per_batch = sink.read(spark).groupBy(BATCH_ID).agg(F.count_distinct(land.file_number(landing)).alias("files"))
    return per_batch.agg(
        F.count(F.lit(1)).alias("batches"),
        F.min(BATCH_ID).alias("first_id"),
        F.max(BATCH_ID).alias("last_id"),
        F.max("files").alias("files_per_batch"),
    )


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files, then, after a restart on the same checkpoint, the other half."""
    events = land.table(spark, sf_dir, "events")
    landing = land.new_landing(spark, events, "waves")
    # A range of ids, which the scan can skip by.
    early = F.col("event_id") < landing.rows * (landing.files // 2)
    run = Run(spark, landing.path, new_parquet(spark), landing.batch_files)
    for name, wave in (("early", events.where(early)), ("late", events.where(~early))):
        land.write_csv(land.numbered_trips(wave, landing), f"{landing.path}/{name}", landing.rows, by="f")
        run.drain()
    return _batches_per_file(run.sink.read(spark), landing)


HEADER = ",".join(TRIP_SCHEMA.names) + "\n"


def _decoy() -> str:
    """A file with one well-formed trip that must not be read."""
    trip = dict.fromkeys(TRIP_SCHEMA.names, "1") | {
        PICKUP: "2015-01-15 19:05:39",
        DROPOFF: "2015-01-15 19:23:42",
        "pickup_longitude": "decoy",
    }
    return HEADER + ",".join(trip.values()) + "\n"


def stream_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished files are read wherever they lie below the landing directory, unfinished or hidden ones never."""
    events = land.table(spark, sf_dir, "events")
    landing = land.new_landing(spark, events, "visibility")
    trips, first_vendor = land.trips_from_events(events), F.col("VendorID") == 1
    land.write_csv(trips.where(first_vendor), f"{landing.path}/flat", landing.rows)
    land.write_csv(trips.where(~first_vendor), f"{landing.path}/incoming/deeper", landing.rows, extension="CSV")
    for name in ("unfinished.csv.part", "_hidden.csv", ".hidden.csv", "other.txt"):
        write_text(spark, f"{landing.path}/{name}", _decoy())
    run = Run(spark, landing.path, new_parquet(spark), max_files=None)
    run.drain()
    return run.sink.read(spark).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pickup_longitude") == "decoy", 1)).alias("decoys")
    )


def stream_empty_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with only a header makes a batch that takes an id but writes nothing."""
    events = land.table(spark, sf_dir, "events")
    landing = land.new_landing(spark, events, "empty")
    write_text(spark, f"{landing.path}/empty.csv", HEADER)
    run = Run(spark, landing.path, new_parquet(spark), max_files=None)
    run.drain()
    land.write_csv(land.trips_from_events(events), f"{landing.path}/full", landing.rows)
    run.drain()
    empty = [r.batch_id for r in run.reports if r.stored_as is None]
    return run.sink.read(spark).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(BATCH_ID).alias("first_id"),
        F.lit(len(empty)).alias("empty_batches"),
    )


def stream_ingest_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_over_events(spark, sf_dir, new_table(spark))
    run.drain()
    return by_day(run.sink.read(spark))


def stream_replay_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_over_events(spark, sf_dir, new_table(spark))
    crash_and_resume(run)
    return by_day(run.sink.read(spark))


class _Dies(RuntimeError):
    pass


def _die(directory: str) -> None:
    raise _Dies(directory)


def stream_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one file each, merged while the stream is down after a crash: one compaction dies before it counts,
    the next one takes in the batch that the stream then replays, a last one the rest; the small directories go."""
    landing = land.numbered_landing(spark, sf_dir)
    run = Run(spark, landing.path, new_parquet(spark), max_files=1)

    def between() -> None:
        try:
            compact(run.sink, spark, before_publish=_die)
        except _Dies:
            pass
        compact(run.sink, spark)
        vacuum(run.sink, spark, older_than_seconds=-60)

    crash_and_resume(run, between=between)
    compact(run.sink, spark)
    vacuum(run.sink, spark, older_than_seconds=-60)
    small = F.lit(len(run.sink.directory_ids(spark))).alias("small_directories")
    return by_day(run.sink.read(spark)).withColumn("small_directories", small)


def stream_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each batch, merged: distinct users and quantiles of the trip length, held against the exact ones."""
    landing = land.numbered_landing(spark, sf_dir)
    run = Run(spark, landing.path, new_parquet(spark), max_files=1)
    run.drain()
    columns = {"distinct": ["pickup_latitude"], "quantiles": [TRIP_LENGTH]}
    sketch_batches(run.sink, spark, **columns)
    ranks = [0.1, 0.5, 0.9]
    found = estimates(run.sink, spark, distinct=columns["distinct"], quantiles={TRIP_LENGTH: ranks})
    stored = run.sink.read(spark)
    found = found.select("rows", F.col("distinct pickup_latitude").alias("users"), F.col(f"quantile {TRIP_LENGTH}").alias("q"))
    # The share of rows below a quantile, and of those not above it: its rank lies between, within the error.
    bounds = []
    for k, rank in enumerate(ranks):
        low = F.avg((F.col(TRIP_LENGTH) < F.col("q")[k]).cast("double"))
        high = F.avg((F.col(TRIP_LENGTH) <= F.col("q")[k]).cast("double"))
        bounds.append((low <= rank + RANK_ERROR) & (high >= rank - RANK_ERROR))
    exact = stored.join(F.broadcast(found)).agg(
        F.first("rows").alias("n"),
        F.count_distinct("pickup_latitude").alias("users"),
        F.first("users").alias("estimated"),
        reduce(Column.__and__, bounds).cast("int").alias("quantiles_within"),
    )
    off = F.abs(F.col("estimated") - F.col("users")) <= 3 * DISTINCT_ERROR * F.col("users")
    return exact.select("n", "users", off.cast("int").alias("users_within"), "quantiles_within")
