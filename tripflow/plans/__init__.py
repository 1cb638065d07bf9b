"""Whole jobs put together from sources, operators and sinks."""

from tripflow.plans.ingest import ingest_file, run_stream, sink_for, start_stream

__all__ = ["ingest_file", "run_stream", "sink_for", "start_stream"]
