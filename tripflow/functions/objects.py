"""Expressions over object references (bucket, key)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
URI_SCHEME = "s3a://"
CSV_SUFFIX = ".csv"
PARTIAL_SUFFIX = ".part"


def object_uri(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit(URI_SCHEME), bucket, F.lit("/"), key)


def landing_path(key: Column, mount: str, prefix: str) -> Column:
    """Where `key` lands below `mount`/`prefix`. Keys are used as given, not URL-decoded; repeated
    slashes and `./` steps in them collapse as they do in a file path. A key with a `../` step could
    lead out of the landing directory and has no landing path: NULL."""
    base = "/".join(filter(None, (mount.rstrip("/"), prefix.strip("/"))))
    path = F.concat(F.lit(f"{base}/"), F.regexp_replace(key, r"(^|/)(\.?/)+", "$1"))
    return F.when(~key.rlike(r"(^|/)\.\.(/|$)"), path)


def is_csv_key(key: Column) -> Column:
    return F.lower(key).endswith(CSV_SUFFIX)


def is_object_ref(bucket: Column, key: Column) -> Column:
    """True when both parts are present and non-empty; never NULL."""
    return F.coalesce((bucket != "") & (key != ""), F.lit(False))
