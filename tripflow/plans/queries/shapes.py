"""Result columns in types that compare exactly with SQL."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.plans import landing as land
from tripflow.schema import DAY_OF_WEEK, TRIP_LENGTH, TRIP_SCHEMA


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("NULL"))


def _time(name: str) -> Column:
    return F.coalesce(F.date_format(name, land.CSV_TIME), F.lit("NULL"))


def cents(name: str) -> Column:
    """Whole cents, so that a sum does not depend on the order of its terms."""
    return F.round(F.col(name).cast("double") * 100).cast("long")


def trip_columns() -> list[Column]:
    """The 19 input columns in types that compare exactly: floats as doubles, times and flag as text."""
    shown = {
        "float": lambda name: F.coalesce(F.col(name).cast("double"), F.lit(-1.0)),
        "timestamp": _time,
        "boolean": lambda name: _text(F.col(name)),
        "int": lambda name: _text(F.col(name)),
        "string": lambda name: _text(F.col(name)),
    }
    return [shown[f.dataType.simpleString()](f.name).alias(f.name) for f in TRIP_SCHEMA]


def derived_columns() -> list[Column]:
    return [F.coalesce(TRIP_LENGTH, F.lit(-1.0)).alias(TRIP_LENGTH), _text(F.col(DAY_OF_WEEK)).alias(DAY_OF_WEEK)]


def by_day(stored: DataFrame, *keys: str) -> DataFrame:
    return stored.groupBy(*keys, DAY_OF_WEEK).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(TRIP_LENGTH).alias("minutes"),
        F.sum(cents("trip_distance")).alias("distance_cents"),
    )
