"""Writing stamped micro-batches to a database table or to parquet."""

from tripflow.sinks.compaction import BatchChanged, compact, vacuum
from tripflow.sinks.jdbc import JdbcSink, write_jdbc_append, write_jdbc_idempotent
from tripflow.sinks.ownership import ForeignBatch
from tripflow.sinks.parquet import ParquetSink, write_parquet_idempotent
from tripflow.sinks.sketches import estimates, sketch_batches

__all__ = [
    "BatchChanged",
    "ForeignBatch",
    "JdbcSink",
    "ParquetSink",
    "compact",
    "estimates",
    "sketch_batches",
    "vacuum",
    "write_jdbc_append",
    "write_jdbc_idempotent",
    "write_parquet_idempotent",
]
