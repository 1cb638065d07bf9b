"""Object-created events (JSON text) to object references."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow import functions as fn

_NAMED = "bucket: struct<name: string>, object: struct<key: string>"
EVENT_SCHEMA = f"detail struct<{_NAMED}>, Records array<struct<s3: struct<{_NAMED}>>>"

_PARSED = "__event"


def normalize_object_events(df: DataFrame, json_col: str) -> DataFrame:
    """Add `bucket` and `key`, one reference per event.

    They come from `detail` when it holds both, otherwise both from the first entry of `Records`.
    A part of an unexpected JSON type counts as missing. Text that is not an event leaves them
    NULL or empty; `split_valid_events` tells these apart.
    """
    event = F.col(_PARSED)
    detail, first = event["detail"], F.try_element_at(event["Records"], F.lit(1))["s3"]
    from_detail = fn.is_object_ref(detail["bucket"]["name"], detail["object"]["key"])
    ref = F.when(from_detail, detail).otherwise(first)
    # Exploding a one-element array keeps later filters from pulling the parser into themselves,
    # which would parse each text twice.
    parsed = df.withColumn(_PARSED, F.explode(F.array(F.from_json(json_col, EVENT_SCHEMA))))
    return parsed.withColumns({"bucket": ref["bucket"]["name"], "key": ref["object"]["key"]}).drop(_PARSED)


def explode_object_records(df: DataFrame, json_col: str) -> DataFrame:
    """`bucket` and `key` in place of the event text, one row per entry of `Records` that names an object.

    Events without records give no rows; an entry without a bucket or key drops out alone. The
    text goes, or an event of n records would repeat its n records in n rows.
    """
    ref = F.col(_PARSED)
    parsed = df.withColumn(_PARSED, F.explode(F.from_json(json_col, EVENT_SCHEMA)["Records"]["s3"])).drop(json_col)
    refs = parsed.withColumns({"bucket": ref["bucket"]["name"], "key": ref["object"]["key"]}).drop(_PARSED)
    return refs.where(F.col("bucket").isNotNull() & F.col("key").isNotNull())


def only_csv_objects(df: DataFrame, key: str = "key") -> DataFrame:
    return df.where(fn.is_csv_key(F.col(key)))


def split_valid_events(df: DataFrame, bucket: str = "bucket", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(events that name an object, events that do not); together they are `df`."""
    valid = fn.is_object_ref(F.col(bucket), F.col(key))
    return df.where(valid), df.where(~valid)


def with_object_uri(df: DataFrame, bucket: str = "bucket", key: str = "key", out: str = "uri") -> DataFrame:
    return df.withColumn(out, fn.object_uri(F.col(bucket), F.col(key)))


def with_landing_path(
    df: DataFrame, mount: str, prefix: str, key: str = "key", out: str = "path", partial_out: str = "partial_path"
) -> DataFrame:
    """The final path of an object and the one it has while it is still being written."""
    path = fn.landing_path(F.col(key), mount, prefix)
    return df.withColumns({out: path, partial_out: F.concat(path, F.lit(fn.objects.PARTIAL_SUFFIX))})
