"""Directories through Hadoop's file system API, so that any URI Spark accepts works."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below `path`; empty when it does not exist."""
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at `path`; nothing is listed."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.exists(hadoop_path)


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with scheme and authority, the way its file system spells it."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.makeQualified(hadoop_path).toString()


def ensure_directory(spark: SparkSession, path: str) -> None:
    """Create `path` unless it exists or is a pattern."""
    if not any(c in path for c in "*?[{"):
        fs, hadoop_path = _resolve(spark, path)
        fs.mkdirs(hadoop_path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None when there is none."""
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return None
    source = fs.open(hadoop_path)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str, *, overwrite: bool = True) -> None:
    """A small marker or header file."""
    fs, hadoop_path = _resolve(spark, path)
    out = fs.create(hadoop_path, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new small file; False if there is one of that name already."""
    fs, hadoop_path = _resolve(spark, path)
    if fs.exists(hadoop_path):
        return False
    try:
        write_text(spark, path, text, overwrite=False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()) or fs.exists(hadoop_path):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a directory with all that is in it; nothing there is no error."""
    fs, hadoop_path = _resolve(spark, path)
    fs.delete(hadoop_path, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files at or below `path`."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def modified_at(spark: SparkSession, path: str) -> float:
    """Seconds since the epoch."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.getFileStatus(hadoop_path).getModificationTime() / 1000
