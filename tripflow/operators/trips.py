"""Derived trip columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow import functions as fn
from tripflow.schema import BATCH_ID, DAY_OF_WEEK, DROPOFF, PICKUP, TRIP_LENGTH


def with_trip_length(
    df: DataFrame, start: str = PICKUP, end: str = DROPOFF, out: str = TRIP_LENGTH
) -> DataFrame:
    return df.withColumn(out, fn.trip_length(F.col(start), F.col(end)))


def with_day_of_week(df: DataFrame, ts: str = PICKUP, out: str = DAY_OF_WEEK) -> DataFrame:
    return df.withColumn(out, fn.day_of_week(F.col(ts)))


def with_batch_id(df: DataFrame, batch_id: int, out: str = BATCH_ID) -> DataFrame:
    return df.withColumn(out, fn.batch_id(batch_id))


def enrich_trips(df: DataFrame) -> DataFrame:
    """Trip length, then day of week: the streaming relation of 21 columns."""
    return with_day_of_week(with_trip_length(df))
