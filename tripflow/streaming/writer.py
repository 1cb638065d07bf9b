"""What happens to each micro-batch."""

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tripflow.operators import with_batch_id
from tripflow.sinks.ownership import NO_STREAM

log = logging.getLogger(__name__)


class Sink(Protocol):
    """A table of stamped batches."""

    replay_safe: bool

    def write(
        self, df: DataFrame, batch_id: int, *, owner: str = NO_STREAM, replay: bool = True, replace: bool = False
    ) -> int: ...

    def last_batch_id(self, spark: SparkSession) -> int | None: ...

    def has_batch(self, spark: SparkSession, batch_id: int) -> bool: ...


# Spark's name for the id of the running stream, which the checkpoint keeps over restarts.
_STREAM = "sql.streaming.queryId"


@dataclass(frozen=True)
class BatchReport:
    """One micro-batch that was dealt with; `stored_as` is None when it was empty."""

    batch_id: int
    stored_as: int | None
    rows: int
    seconds: float


def store_batch(
    df: DataFrame, sink: Sink, batch_id: int, stored_as: int, *, owner: str = NO_STREAM, replay: bool, replace: bool = False
) -> BatchReport:
    """Skip an empty batch, which then takes no id in the sink; stamp and write any other."""
    started = time.monotonic()
    if df.isEmpty():
        return BatchReport(batch_id, None, 0, time.monotonic() - started)
    rows = sink.write(with_batch_id(df, stored_as), stored_as, owner=owner, replay=replay, replace=replace)
    return BatchReport(batch_id, stored_as, rows, time.monotonic() - started)


def make_batch_writer(
    sink: Sink,
    *,
    first_batch_id: int = 0,
    stateful: bool = False,
    on_batch: Callable[[BatchReport], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: skip empty batches, stamp, write, report.

    The rows of a `stateful` plan are kept while they are tested and written, so that its state is gone through once.

    Rows are stamped `first_batch_id` + batch id. Any failure is logged and raised, which stops the
    stream. Only a batch that does not directly follow one this writer has finished can have left
    rows behind, so only then is the sink asked to look for them.
    """
    finished: int | None = None

    def write_batch(df: DataFrame, batch_id: int) -> None:
        nonlocal finished
        replay, finished = finished is None or batch_id != finished + 1, None
        stream = df.sparkSession.sparkContext.getLocalProperty(_STREAM) or NO_STREAM
        if stateful:
            df = df.persist()
        try:
            report = store_batch(df, sink, batch_id, first_batch_id + batch_id, owner=stream, replay=replay)
        except Exception:
            log.exception("batch %s failed; the stream stops", batch_id)
            raise
        finally:
            if stateful:
                df.unpersist()
        finished = batch_id
        log.info("%s", report)
        if on_batch:
            on_batch(report)

    return write_batch
