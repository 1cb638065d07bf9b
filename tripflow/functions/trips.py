"""Expressions over trip columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_MINUTE = 60


def trip_length(start: Column, end: Column) -> Column:
    """Minutes from `start` to `end` as a double.

    Both sides are floored to whole seconds first. Negative when `end` is earlier, NULL when
    either side is.
    """
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return seconds / F.lit(SECONDS_PER_MINUTE)


def day_of_week(ts: Column) -> Column:
    """`Mon` ... `Sun`."""
    return F.date_format(ts, "E")


def batch_id(value: int) -> Column:
    """The id as an int literal, so that the column type does not depend on how large the id is."""
    return F.lit(value).cast("int")
