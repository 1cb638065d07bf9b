"""Runs of the ingest stream, whole or broken off, and new places to store into."""

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

from tripflow.config import PipelineConfig
from tripflow.plans import landing as land
from tripflow.plans.ingest import start_stream
from tripflow.session import shared_dir
from tripflow.sinks import JdbcSink, ParquetSink
from tripflow.streaming import BatchReport, Sink


@dataclass
class Run:
    """A landing directory, a sink and a checkpoint, over which the stream is run once or more often."""

    spark: SparkSession
    input_path: str
    sink: Sink
    max_files: int | None = 1
    output_mode: str = "append"
    reports: list[BatchReport] = field(default_factory=list)
    checkpoint: str = ""

    def __post_init__(self) -> None:
        self.checkpoint = shared_dir(self.spark, "checkpoint")

    def drain(self, sink: Sink | None = None, first_batch_id: int = 0) -> None:
        """Take everything that is waiting."""
        config = PipelineConfig(
            self.input_path,
            self.checkpoint,
            output_mode=self.output_mode,
            max_files_per_trigger=self.max_files,
            first_batch_id=first_batch_id,
        )
        start_stream(self.spark, config, sink or self.sink, self.reports.append).awaitTermination()


def run_over_events(spark: SparkSession, sf_dir: str, sink: Sink | None = None, **settings: object) -> Run:
    files = land.event_landing(spark, sf_dir)
    return Run(spark, files.path, sink or new_parquet(spark), files.batch_files, **settings)


def new_parquet(spark: SparkSession) -> ParquetSink:
    return ParquetSink(shared_dir(spark, "sink"))


@dataclass
class _LostAfterWrite:
    """A sink whose caller dies right after the write of batch `batch_id`."""

    sink: Sink
    batch_id: int
    replay_safe: bool = True

    def write(self, df: DataFrame, batch_id: int, **how: object) -> int:
        rows = self.sink.write(df, batch_id, **how)
        if batch_id == self.batch_id:
            raise RuntimeError("lost after the write, before the commit")
        return rows

    def last_batch_id(self, spark: SparkSession) -> int | None:
        return self.sink.last_batch_id(spark)

    def has_batch(self, spark: SparkSession, batch_id: int) -> bool:
        return self.sink.has_batch(spark, batch_id)


def crash_and_resume(
    run: Run, refused_id: int | None = None, between: Callable[[], None] | None = None
) -> None:
    """Lose the second batch between its write and its commit, then start again, after `between`.

    A start with `refused_id` as the first id must fail before that.
    """
    try:
        run.drain(_LostAfterWrite(run.sink, 1))
    except StreamingQueryException:
        pass
    else:
        raise AssertionError("the stream should have stopped")
    if refused_id is not None:
        try:
            run.drain(first_batch_id=refused_id)
        except ValueError:
            pass
        else:
            raise AssertionError("another first id should have been refused")
    if between:
        between()
    run.drain()


def new_table(spark: SparkSession) -> JdbcSink:
    return JdbcSink(land.database_table(spark, f"trips_{uuid.uuid4().hex}"))
