"""Micro-batch writing and stream control."""

from tripflow.streaming.query import start_ingest
from tripflow.streaming.state import StateReport, state_report
from tripflow.streaming.writer import BatchReport, Sink, make_batch_writer

__all__ = ["BatchReport", "Sink", "StateReport", "make_batch_writer", "start_ingest", "state_report"]
