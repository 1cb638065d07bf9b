"""The two ways trips get in: the continuous stream, and named files as one batch."""

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tripflow.config import PipelineConfig
from tripflow.operators import enrich_trips
from tripflow.schema import TRIP_SCHEMA
from tripflow.sinks import JdbcSink, ParquetSink
from tripflow.sources import read_trips_batch, read_trips_stream
from tripflow.sources.files import ensure_directory
from tripflow.streaming import BatchReport, Sink, start_ingest
from tripflow.streaming.writer import store_batch

log = logging.getLogger(__name__)


def sink_for(config: PipelineConfig) -> Sink:
    """Parquet when the configuration names a path for it, the database table otherwise."""
    if config.parquet_path:
        return ParquetSink(config.parquet_path)
    return JdbcSink(config.jdbc_table(), config.replay_safe)


def start_stream(
    spark: SparkSession,
    config: PipelineConfig,
    sink: Sink | None = None,
    on_batch: Callable[[BatchReport], None] | None = None,
) -> StreamingQuery:
    # The stream may be up before the first file is.
    ensure_directory(spark, config.input_path)
    trips = read_trips_stream(
        spark,
        config.input_path,
        max_files_per_trigger=config.max_files_per_trigger,
        max_bytes_per_trigger=config.max_bytes_per_trigger,
        max_file_age=config.max_file_age,
        path_glob=config.path_glob,
        recursive=config.recursive,
        strict_header=config.strict_header,
        **config.source_options,
    )
    return start_ingest(
        enrich_trips(trips),
        sink or sink_for(config),
        config.checkpoint_path,
        trigger=config.trigger,
        output_mode=config.output_mode,
        first_batch_id=config.first_batch_id,
        on_batch=on_batch,
    )


def run_stream(spark: SparkSession, config: PipelineConfig, sink: Sink | None = None) -> None:
    """Run until stopped, or until nothing is waiting when no trigger is set. A failed batch raises."""
    start_stream(spark, config, sink).awaitTermination()


def ingest_file(
    spark: SparkSession,
    path: str | Sequence[str],
    sink: Sink | None = None,
    batch_id: int | None = None,
    *,
    schema: StructType = TRIP_SCHEMA,
    replace: bool = False,
) -> DataFrame | BatchReport:
    """Read and derive the named objects and return the rows; given a sink, store them as batch `batch_id` instead.

    Stored objects are treated and reported like a batch of the stream: without a row nothing is stored and the id
    stays free. A batch the sink already holds is only overwritten with `replace`. Beside a stream, which counts up
    from 0, negative ids are free.
    """
    # A named object is taken as it is: no glob, no descent.
    trips = enrich_trips(read_trips_batch(spark, path, schema, path_glob=None, recursive=False))
    if sink is None:
        return trips
    if batch_id is None:
        raise ValueError("storing needs a batch id")
    if sink.has_batch(spark, batch_id) and not replace:
        raise ValueError(f"the sink already holds batch {batch_id}")
    report = store_batch(trips, sink, batch_id, batch_id, replay=False, replace=replace)
    log.info("%s", report)
    return report
