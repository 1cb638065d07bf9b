"""The registered queries: every operator, run over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripflow.plans.queries import event_time, events, projections, scans, stored, streams, whole
from tripflow.session import pin_settings

Query = Callable[[SparkSession, str], DataFrame]


def _pinned(query: Query) -> Query:
    """Run `query` under the library's settings, whichever session it is given."""
    return lambda spark, sf_dir: query(pin_settings(spark), sf_dir)


QUERIES: dict[str, Query] = {
    query.__name__: _pinned(query)
    for query in (
        projections.trip_length,
        projections.trip_length_subsecond,
        projections.day_of_week,
        projections.batch_stamp,
        projections.object_uri,
        projections.landing_path,
        events.event_normalize,
        events.event_valid,
        events.event_rejected,
        events.event_explode,
        events.event_manifest,
        events.csv_key_filter,
        scans.csv_scan,
        scans.csv_coercion,
        scans.batch_ingest,
        scans.lineitem_ingest,
        scans.object_empty_file,
        streams.stream_ingest,
        streams.stream_update_mode,
        streams.stream_replay,
        streams.stream_resume_same_ids,
        streams.batch_row_counts,
        streams.stream_file_per_batch,
        streams.stream_batch_ids,
        streams.stream_resume,
        streams.stream_visibility,
        streams.stream_empty_file,
        streams.stream_compaction,
        streams.stream_sketches,
        event_time.window_tumbling,
        event_time.window_sliding,
        event_time.window_session,
        event_time.stream_dedup,
        event_time.announced_join,
        streams.stream_ingest_jdbc,
        streams.stream_replay_jdbc,
        stored.parquet_replace,
        stored.row_count,
        stored.preview10,
        stored.parquet_readback,
        whole.trip_overlaps,
        whole.trip_numbers,
        whole.running_distance,
        whole.reconciliation,
        stored.jdbc_append,
        stored.sink_readback,
        stored.jdbc_row_count,
        stored.jdbc_preview10,
    )
}
