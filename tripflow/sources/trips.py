"""Trip CSV files under a declared schema."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tripflow.schema import TRIP_SCHEMA

# Fixed value: finished files end in .csv in any case, so `x.csv.part` is not input yet.
CSV_GLOB = "*.[cC][sS][vV]"

# Spark's own limit is a week: a file that arrives with a modification time more than a week older
# than the newest one seen would be passed over without a word.
ANY_AGE = "36500d"


def _csv_options(strict_header: bool, path_glob: str | None, recursive: bool) -> dict[str, object]:
    options = {"header": True, "enforceSchema": not strict_header, "recursiveFileLookup": recursive}
    if path_glob:
        options["pathGlobFilter"] = path_glob
    return options


def read_trips_batch(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType = TRIP_SCHEMA,
    *,
    path_glob: str | None = CSV_GLOB,
    recursive: bool = True,
    strict_header: bool = False,
    **options: object,
) -> DataFrame:
    """The rows of the CSV files at `path` (a file, a directory, or several).

    Columns bind by position and a field that does not parse is NULL, its row kept.
    `strict_header` makes a header that does not match the schema an error instead.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.schema(schema).options(**_csv_options(strict_header, path_glob, recursive))
    return reader.options(**options).csv(paths)


def read_trips_stream(
    spark: SparkSession,
    path: str,
    schema: StructType = TRIP_SCHEMA,
    *,
    max_files_per_trigger: int | None = 1,
    max_bytes_per_trigger: int | None = None,
    max_file_age: str = ANY_AGE,
    path_glob: str | None = CSV_GLOB,
    recursive: bool = True,
    strict_header: bool = False,
    **options: object,
) -> DataFrame:
    """Watch a directory; each new file becomes rows, oldest modification time first.

    Admission is by files or by bytes per micro-batch; the byte limit wins when both are given.
    With neither, a batch takes everything that is waiting. The driver remembers each file for
    `max_file_age`, so a shorter one saves memory where files never arrive late. Further file
    source options such as `cleanSource` pass through.
    """
    reader = spark.readStream.schema(schema).options(**_csv_options(strict_header, path_glob, recursive))
    reader = reader.option("maxFileAge", max_file_age)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    elif max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.options(**options).csv(path)
