"""What a stateful stream keeps, from the progress that Spark reports."""

from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class StateReport:
    """State after the last batch of a run: rows and bytes held, and rows that came too late in all its batches."""

    rows: int
    bytes: int
    late_rows: int


def state_report(query: StreamingQuery) -> StateReport:
    """Of all stateful operators together; Spark remembers the last 100 batches of a run."""
    progress = query.recentProgress
    last = progress[-1].stateOperators if progress else []
    late = sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
    return StateReport(sum(op.numRowsTotal for op in last), sum(op.memoryUsedBytes for op in last), late)
