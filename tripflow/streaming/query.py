"""Starting the ingest stream."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tripflow.sources.files import exists, read_text, write_text
from tripflow.streaming.writer import BatchReport, Sink, make_batch_writer

# In the checkpoint folder, beside Spark's own files.
FIRST_ID_NOTE = "tripflow-first-batch-id"


def start_ingest(
    trips: DataFrame,
    sink: Sink,
    checkpoint_path: str,
    *,
    trigger: str | None = None,
    output_mode: str = "append",
    first_batch_id: int = 0,
    stateful: bool = False,
    on_batch: Callable[[BatchReport], None] | None = None,
) -> StreamingQuery:
    """Write the stream `trips` to `sink`, resuming from the checkpoint.

    `trigger` is a processing-time interval such as `30 seconds`; without one, everything that is
    waiting is taken, in admitted batches, and the query ends. `stateful` tells that the stream windows, joins or
    deduplicates.
    """
    started = exists(trips.sparkSession, f"{checkpoint_path}/offsets")
    if not started:
        _refuse_reused_ids(trips.sparkSession, sink, checkpoint_path, first_batch_id)
    _bind_first_id(trips.sparkSession, checkpoint_path, first_batch_id, started)
    writer = make_batch_writer(sink, first_batch_id=first_batch_id, stateful=stateful, on_batch=on_batch)
    stream = trips.writeStream.foreachBatch(writer).outputMode(output_mode)
    stream = stream.option("checkpointLocation", checkpoint_path)
    stream = stream.trigger(processingTime=trigger) if trigger else stream.trigger(availableNow=True)
    return stream.start()


def _refuse_reused_ids(spark: SparkSession, sink: Sink, checkpoint_path: str, first_batch_id: int) -> None:
    """A new checkpoint counts batches from 0 again; a replay-safe sink would take them for replays
    of the batches it already holds and replace those."""
    last = sink.last_batch_id(spark) if sink.replay_safe else None
    if last is not None and last >= first_batch_id:
        raise ValueError(
            f"the checkpoint {checkpoint_path} is new, but the sink holds batches up to {last}: restore the "
            f"checkpoint. Without it every file of the input is read again and stored a second time; move those "
            f"that are stored out of the input first, then set first_batch_id to {last + 1} or more"
        )


def _bind_first_id(spark: SparkSession, checkpoint_path: str, first_batch_id: int, started: bool) -> None:
    """A batch that is replayed under another id would not be found in the sink and be stored twice, so a
    checkpoint keeps the first id that it was started with."""
    note = f"{checkpoint_path}/{FIRST_ID_NOTE}"
    bound = read_text(spark, note)
    if started and bound and int(bound) != first_batch_id:
        raise ValueError(
            f"the checkpoint {checkpoint_path} was started with first_batch_id {bound}, not {first_batch_id}: "
            "a batch that is replayed would be stored again under another id"
        )
    if bound != str(first_batch_id):
        write_text(spark, note, str(first_batch_id))
