"""Reading: trip CSV files as a stream or a batch, and the stored table."""

from tripflow.sources.trips import ANY_AGE, CSV_GLOB, read_trips_batch, read_trips_stream
from tripflow.sources.table import JdbcTable, read_sink_table, sink_count, sink_preview

__all__ = [
    "ANY_AGE",
    "CSV_GLOB",
    "JdbcTable",
    "read_sink_table",
    "read_trips_batch",
    "read_trips_stream",
    "sink_count",
    "sink_preview",
]
