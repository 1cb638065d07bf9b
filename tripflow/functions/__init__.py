"""Column expressions; every one is a built-in expression tree, so it stays inside codegen."""

from tripflow.functions.objects import is_csv_key, is_object_ref, landing_path, object_uri
from tripflow.functions.trips import batch_id, day_of_week, trip_length

__all__ = [
    "batch_id",
    "day_of_week",
    "is_csv_key",
    "is_object_ref",
    "landing_path",
    "object_uri",
    "trip_length",
]
