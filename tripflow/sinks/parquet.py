"""Parquet, one directory per micro-batch, and runs into which batches have been merged."""

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripflow.schema import BATCH_ID, STORED_SCHEMA
from tripflow.sinks import manifest as manifests
from tripflow.sinks.counting import write_counted
from tripflow.sinks.ownership import NO_STREAM, check_owner
from tripflow.sources.files import child_names, exists, read_text, write_text

log = logging.getLogger(__name__)

WRITE_ATTEMPTS = 3

_BATCH_DIR = re.compile(rf"{BATCH_ID}=(-?\d+)")
_MARKER = re.compile(r"-?\d+")
# How Spark names a data file: the task's partition, the write's unique id, the number of the file in its task.
_DATA_FILE = re.compile(r"part-(\d+)-([0-9a-f-]{36})[.-]c(\d+)\..*")


def write_parquet_idempotent(df: DataFrame, batch_id: int, path: str) -> int:
    """Replace batch `batch_id` below `path` by the rows of `df`; returns their number.

    The batch owns the directory `Id=<batch_id>`, so writing it again leaves one copy, and no
    other batch is touched. Files that do not belong there, left by a lost task under a committer
    that moves files early or by a driver that was still at work, show as a surplus in the row
    counts of the footers; the batch is then written afresh. Where the count of rows written was lost
    on its way to the driver, the names of the files tell whether one write made them all, and the
    footers give the count.
    """
    rows, directory = df.drop(BATCH_ID), f"{path}/{BATCH_ID}={batch_id}"
    for attempt in range(1, WRITE_ATTEMPTS + 1):
        written = write_counted(rows, lambda out: out.write.mode("overwrite").parquet(directory))
        found = df.sparkSession.read.schema(rows.schema).parquet(directory).count()
        if found == written or (written is None and _from_one_write(child_names(df.sparkSession, directory))):
            return found
        log.warning("batch %s: %s rows written, %s found, attempt %s", batch_id, written, found, attempt)
    raise RuntimeError(f"batch {batch_id}: the rows found keep differing from those written")


def _from_one_write(names: Sequence[str]) -> bool:
    """Whether data files all come from one write, and no two from the same place in it; other names are no evidence."""
    files = [_DATA_FILE.fullmatch(name) for name in names if not name.startswith(("_", "."))]
    if not all(files) or len({file[2] for file in files}) > 1:
        return False
    return len({(int(file[1]), int(file[3])) for file in files}) == len(files)


@dataclass(frozen=True)
class ParquetSink:
    path: str
    schema: StructType = STORED_SCHEMA

    replay_safe = True

    def write(
        self, df: DataFrame, batch_id: int, *, owner: str = NO_STREAM, replay: bool = True, replace: bool = False
    ) -> int:
        """Store the batch for `owner`, unless a marker and the footers say that this is done already.

        The marker holds the owner from before the write and, from after it, the number of rows. A replay of a batch
        that is whole so leaves its files alone; a torn one is written afresh. A batch that was merged into a run is
        whole; replacing it writes its own directory again, which counts once the manifest says so.
        """
        spark, marker = df.sparkSession, self.marker(batch_id)
        merged = manifests.load(spark, self.path).run_of(batch_id)
        if merged and not replace:
            check_owner(batch_id, merged.owner_of(batch_id), owner)
            return self.read_parts(spark, [], [merged]).where(F.col(BATCH_ID) == batch_id).count()
        noted = read_text(spark, marker)
        # An empty marker is one whose writer died over it.
        holder, _, rows = (noted or "").partition("\n")
        if holder and not replace:
            check_owner(batch_id, holder, owner)
            if rows and self._found(df, batch_id) == int(rows):
                return int(rows)
        else:
            write_text(spark, marker, owner, overwrite=noted is not None)
        written = write_parquet_idempotent(df, batch_id, self.path)
        if merged:
            manifests.publish(spark, self.path, manifests.load(spark, self.path).without_batch(batch_id))
        write_text(spark, marker, f"{owner}\n{written}")
        return written

    def _found(self, df: DataFrame, batch_id: int) -> int:
        """Rows of a batch by the footers of its files."""
        if not exists(df.sparkSession, self.directory(batch_id)):
            return 0
        return df.sparkSession.read.schema(df.drop(BATCH_ID).schema).parquet(self.directory(batch_id)).count()

    def directory(self, batch_id: int) -> str:
        return f"{self.path}/{BATCH_ID}={batch_id}"

    # Spark passes over names that begin with an underscore.

    def marker(self, batch_id: int) -> str:
        return f"{self.path}/_batches/{batch_id}"

    @property
    def runs_dir(self) -> str:
        return f"{self.path}/_runs"

    def run_dir(self, name: str) -> str:
        return f"{self.runs_dir}/{name}"

    def directory_ids(self, spark: SparkSession) -> list[int]:
        """Batches with a directory of their own, from the directory names alone."""
        names = (_BATCH_DIR.fullmatch(name) for name in child_names(spark, self.path))
        return sorted(int(match[1]) for match in names if match)

    def batch_ids(self, spark: SparkSession) -> list[int]:
        """Ids stored so far, from directory names and the manifest."""
        merged = (i for run in manifests.load(spark, self.path).runs for i in run.batch_ids())
        return sorted({*self.directory_ids(spark), *merged})

    def last_batch_id(self, spark: SparkSession) -> int | None:
        taken = (int(name) for name in child_names(spark, f"{self.path}/_batches") if _MARKER.fullmatch(name))
        merged = (run.last_id for run in manifests.load(spark, self.path).runs)
        return max((*taken, *self.directory_ids(spark), *merged), default=None)

    def has_batch(self, spark: SparkSession, batch_id: int) -> bool:
        found = exists(spark, self.directory(batch_id))
        return found or manifests.load(spark, self.path).run_of(batch_id) is not None

    def read(self, spark: SparkSession) -> DataFrame:
        """All stored rows, none where no batch had any yet. Merged batches are read from their runs, whose files are few."""
        merged = manifests.load(spark, self.path)
        if not merged.runs and not exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        if not merged.runs:
            return spark.read.schema(self.schema).parquet(self.path)
        own = [i for i in self.directory_ids(spark) if merged.run_of(i) is None]
        return self.read_parts(spark, own, list(merged.runs))

    def read_parts(self, spark: SparkSession, batch_ids: Sequence[int], runs: Sequence["manifests.MergedRun"]) -> DataFrame:
        """The rows of batches that have their own directories, and of runs."""
        reader = spark.read.schema(self.schema)
        parts = []
        if batch_ids:
            parts.append(reader.option("basePath", self.path).parquet(*map(self.directory, batch_ids)))
        whole = [self.run_dir(run.name) for run in runs if not run.dropped]
        if whole:
            parts.append(spark.read.schema(self.schema).parquet(*whole))
        for run in runs:
            if run.dropped:
                rows = spark.read.schema(self.schema).parquet(self.run_dir(run.name))
                parts.append(rows.where(~F.col(BATCH_ID).isin(*run.dropped)))
        return reduce(DataFrame.unionByName, parts)

    def count(self, spark: SparkSession) -> DataFrame:
        """One row, `n`: answered from the parquet footers."""
        return self.read(spark).agg(F.count(F.lit(1)).alias("n"))

    def preview(self, spark: SparkSession, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
        rows = self.read(spark)
        return (rows.orderBy(*order_by) if order_by else rows).limit(n)
