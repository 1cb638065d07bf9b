"""The trip record: input contract, derived columns, stored row."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Names, order and types of the CSV input. Columns bind to a file by position.
_INPUT_COLUMNS = {
    "VendorID": IntegerType,
    "tpep_pickup_datetime": TimestampType,
    "tpep_dropoff_datetime": TimestampType,
    "passenger_count": IntegerType,
    "trip_distance": FloatType,
    "pickup_longitude": StringType,
    "pickup_latitude": StringType,
    "RateCodeID": IntegerType,
    "store_and_fwd_flag": BooleanType,
    "dropoff_longitude": StringType,
    "dropoff_latitude": StringType,
    "payment_type": IntegerType,
    "fare_amount": FloatType,
    "extra": FloatType,
    "mta_tax": FloatType,
    "tip_amount": FloatType,
    "tolls_amount": FloatType,
    "improvement_surcharge": FloatType,
    "total_amount": FloatType,
}

# Columns the derivations read and write.
PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
TRIP_LENGTH = "trip_Length"
DAY_OF_WEEK = "day_of_week"
BATCH_ID = "Id"

TRIP_SCHEMA = StructType([StructField(name, kind()) for name, kind in _INPUT_COLUMNS.items()])

ENRICHED_SCHEMA = StructType(
    TRIP_SCHEMA.fields
    + [StructField(TRIP_LENGTH, DoubleType()), StructField(DAY_OF_WEEK, StringType())]
)

STORED_SCHEMA = StructType(ENRICHED_SCHEMA.fields + [StructField(BATCH_ID, IntegerType())])
