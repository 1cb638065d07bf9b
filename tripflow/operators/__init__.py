"""DataFrame to DataFrame operators; they work on batch and streaming frames alike."""

from tripflow.operators.event_time import (
    drop_redelivered,
    join_announced,
    session_totals,
    sliding_totals,
    trip_identity,
    tumbling_totals,
)
from tripflow.operators.events import (
    EVENT_SCHEMA,
    explode_object_records,
    normalize_object_events,
    only_csv_objects,
    split_valid_events,
    with_landing_path,
    with_object_uri,
)
from tripflow.operators.intervals import join_overlapping
from tripflow.operators.ordering import with_global_number, with_running_total
from tripflow.operators.reconcile import reconcile
from tripflow.operators.trips import enrich_trips, with_batch_id, with_day_of_week, with_trip_length

__all__ = [
    "EVENT_SCHEMA",
    "drop_redelivered",
    "enrich_trips",
    "explode_object_records",
    "join_announced",
    "join_overlapping",
    "normalize_object_events",
    "only_csv_objects",
    "reconcile",
    "session_totals",
    "sliding_totals",
    "split_valid_events",
    "trip_identity",
    "tumbling_totals",
    "with_batch_id",
    "with_day_of_week",
    "with_global_number",
    "with_landing_path",
    "with_object_uri",
    "with_running_total",
    "with_trip_length",
]
