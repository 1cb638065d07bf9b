"""Operators that keep state by time: windows, deduplication, and the join of announcements with what they announce.

All work on streams and on stored tables alike; on a table nothing is late and everything is final. State is keyed, so it
is spread by key over the tasks, and a watermark bounds it.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripflow.schema import PICKUP, TRIP_LENGTH, TRIP_SCHEMA

WINDOW_START, WINDOW_END = "window_start", "window_end"
# A window's totals, after the keys.
TOTALS = f"{WINDOW_START} timestamp, {WINDOW_END} timestamp, n long, minutes double, distance_cents long"

_WINDOW = "__window"
_ARRIVED, _IDENTITY = "__arrived", "__identity"


def _totals(trips: DataFrame, window: Column, delay: str | None, keys: Sequence[str]) -> DataFrame:
    timed = trips.withWatermark(PICKUP, delay) if delay else trips
    cents = F.round(F.col("trip_distance").cast("double") * 100).cast("long")
    found = timed.groupBy(window.alias(_WINDOW), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(TRIP_LENGTH).alias("minutes"), F.sum(cents).alias("distance_cents")
    )
    start, end = F.col(f"{_WINDOW}.start").alias(WINDOW_START), F.col(f"{_WINDOW}.end").alias(WINDOW_END)
    return found.select(*keys, start, end, "n", "minutes", "distance_cents")


def tumbling_totals(
    trips: DataFrame, length: str, *, delay: str | None = None, keys: Sequence[str] = ("VendorID",)
) -> DataFrame:
    """Trips, minutes and distance by pickup in windows of `length`, and by `keys`.

    On a stream, `delay` is how much a trip may come after later ones. A window is final, and given out in append mode,
    when the watermark, the latest pickup less `delay`, has passed its end; trips for windows that are final are left out
    and counted in the `late_rows` of the state report. Trips without a pickup belong to no window.
    """
    return _totals(trips, F.window(PICKUP, length), delay, keys)


def sliding_totals(
    trips: DataFrame, length: str, step: str, *, delay: str | None = None, keys: Sequence[str] = ("VendorID",)
) -> DataFrame:
    """The same in windows that begin every `step`; a trip counts in each window that holds its pickup."""
    return _totals(trips, F.window(PICKUP, length, step), delay, keys)


def session_totals(
    trips: DataFrame, gap: str, *, delay: str | None = None, keys: Sequence[str] = ("VendorID",)
) -> DataFrame:
    """The same in sessions: trips of equal `keys` whose pickups are at most `gap` apart from one to the next.

    With `spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition` sessions are merged before the shuffle,
    so a key with very many trips sends few rows.
    """
    return _totals(trips, F.session_window(PICKUP, gap), delay, keys)


def trip_identity(schema: StructType = TRIP_SCHEMA) -> Column:
    """128 bits that name a trip: equal for trips that are equal in all columns, NULLs included."""
    whole = F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false"})
    return F.unhex(F.md5(whole))


def drop_redelivered(trips: DataFrame, within: str, schema: StructType = TRIP_SCHEMA) -> DataFrame:
    """Each trip once, however many files bring it, as long as they come within `within` of the first.

    Time is that of arrival, not of the trip: a redelivered file may hold old trips, and no trip is left out as late. The
    time of a batch is kept in the checkpoint, so a replay decides alike. For each trip of the last `within` the state holds
    16 bytes and a time.
    """
    if not trips.isStreaming:
        return trips.withColumn(_IDENTITY, trip_identity(schema)).dropDuplicates([_IDENTITY]).drop(_IDENTITY)
    named = trips.withColumns({_IDENTITY: trip_identity(schema), _ARRIVED: F.current_timestamp()})
    once = named.withWatermark(_ARRIVED, within).dropDuplicatesWithinWatermark([_IDENTITY])
    return once.drop(_IDENTITY, _ARRIVED)


def join_announced(
    refs: DataFrame,
    rows: DataFrame,
    *,
    announced_at: str,
    arrived_at: str,
    within: str,
    delay: str = "0 seconds",
    on: Sequence[str] = ("bucket", "key"),
) -> DataFrame:
    """Object references with the rows that they announce; references whose rows never came have NULLs there.

    A row belongs to a reference of equal `on` if it arrived from then on and not later than `within` after. Both sides
    may be out of order by `delay`. On a stream both are kept until the slower of the two watermarks has passed what could
    still meet them, and only then is a reference given out as unmatched.
    """
    if set(refs.columns) & set(rows.columns) - set(on):
        raise ValueError(f"columns on both sides: {sorted(set(refs.columns) & set(rows.columns) - set(on))}")
    left = refs.withWatermark(announced_at, delay)
    right = rows.withColumnsRenamed({name: f"__{name}" for name in on}).withWatermark(arrived_at, delay)
    equal = [F.col(name) == F.col(f"__{name}") for name in on]
    start, interval = F.col(announced_at), F.expr(f"INTERVAL {within}")
    in_time = (F.col(arrived_at) >= start) & (F.col(arrived_at) <= start + interval)
    joined = left.join(right, [*equal, in_time], "left_outer")
    return joined.drop(*(f"__{name}" for name in on))
