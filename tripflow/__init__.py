"""Trip record ingestion on Spark."""

from tripflow.config import PipelineConfig
from tripflow.plans import ingest_file, run_stream, start_stream
from tripflow.schema import ENRICHED_SCHEMA, STORED_SCHEMA, TRIP_SCHEMA
from tripflow.session import build_session, pin_settings

__all__ = [
    "ENRICHED_SCHEMA",
    "PipelineConfig",
    "STORED_SCHEMA",
    "TRIP_SCHEMA",
    "build_session",
    "ingest_file",
    "pin_settings",
    "run_stream",
    "start_stream",
]
