"""Session settings the library depends on."""

import tempfile
import uuid
from collections.abc import Mapping
from functools import cache

from pyspark.sql import SparkSession

SETTINGS = {
    # Times without a zone mean the same whatever zone the JVMs run in.
    "spark.sql.session.timeZone": "UTC",
    # The default, INT96, carries no statistics, so a filter on the pickup time would read every file.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # A fifth smaller than the default, snappy, on trips, and no slower to write.
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app_name: str = "tripflow", spark_conf: Mapping[str, str] | None = None) -> SparkSession:
    """A session with the given settings and, where these are silent, the library's.

    The master is left to spark-submit.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in (SETTINGS | dict(spark_conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_settings(spark: SparkSession) -> SparkSession:
    """The library's settings in a session that was made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that `spark.checkpoint.dir` names, which all executors must see.

    Only a local master may do without the setting: there every task runs on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        root = _local_root()
    return f"{root.rstrip('/')}/tripflow/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tripflow-")
