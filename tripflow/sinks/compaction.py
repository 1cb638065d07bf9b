"""Merging the many small batch directories of a parquet sink into few large runs.

Batches that are whole by their markers are packed by size, neighbours together, and each pack is written as one run
with its batch ids among the columns. Publishing the manifest then moves readers and replays over at once; until that
the run is not seen, and a compaction that dies costs nothing but its unfinished run. Packs are published one by one, so
what is done stays done. The old directories stay readable until `vacuum` removes them.

Runs below the target size are merged again with their neighbours, but only into one at least twice as large as
the largest of them: each row is written about log2(target / batch) times.
"""

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tripflow.sinks import manifest as mf
from tripflow.sinks.counting import write_counted
from tripflow.sinks.parquet import ParquetSink
from tripflow.sources.files import child_names, delete, modified_at, read_text, size_of

log = logging.getLogger(__name__)

TARGET_BYTES = 8 << 30
FILE_BYTES = 512 << 20


class BatchChanged(RuntimeError):
    """A batch was written again while it was being merged."""


@dataclass(frozen=True)
class _Unit:
    """A batch with the text of its marker, or a run."""

    first_id: int
    size: int
    rows: int
    batch_id: int | None = None
    marker: str | None = None
    run: mf.MergedRun | None = None


def _units(sink: ParquetSink, spark: SparkSession, current: mf.Manifest, target: int) -> list[_Unit]:
    found = [
        _Unit(run.first_id, run.size, run.rows, run=run) for run in current.runs if run.size < target and not run.dropped
    ]
    for batch_id in sink.directory_ids(spark):
        if current.run_of(batch_id) is not None:
            continue
        marker = read_text(spark, sink.marker(batch_id)) or ""
        owner, _, rows = marker.partition("\n")
        size = size_of(spark, sink.directory(batch_id))
        # Without a row count the batch is still being written, or torn.
        if owner and rows and size < target:
            found.append(_Unit(batch_id, size, int(rows), batch_id=batch_id, marker=marker))
    return sorted(found, key=lambda unit: unit.first_id)


def _packs(units: list[_Unit], target: int) -> list[list[_Unit]]:
    """Neighbours, up to the target size together; only those worth writing again."""
    packs, held, size = [], [], 0
    for unit in units:
        if held and size + unit.size > target:
            packs.append(held)
            held, size = [], 0
        held.append(unit)
        size += unit.size
    packs.append(held)
    return [p for p in packs if len(p) > 1 and sum(u.size for u in p) >= 2 * max(u.size for u in p)]


def _read(sink: ParquetSink, spark: SparkSession, pack: list[_Unit]) -> DataFrame:
    return sink.read_parts(spark, [u.batch_id for u in pack if u.run is None], [u.run for u in pack if u.run])


def compact(
    sink: ParquetSink,
    spark: SparkSession,
    *,
    target_bytes: int = TARGET_BYTES,
    file_bytes: int = FILE_BYTES,
    before_publish: Callable[[str], None] | None = None,
) -> list[mf.MergedRun]:
    """Merge what is whole into runs of about `target_bytes`, in files of about `file_bytes`; returns the new runs.

    A stream may go on storing meanwhile. One compaction of a sink runs at a time: a second one, or a batch replaced
    meanwhile, is noticed before publishing and raises. `before_publish` is called with each run's directory.
    """
    done = []
    for pack in _packs(_units(sink, spark, mf.load(spark, sink.path), target_bytes), target_bytes):
        current = mf.load(spark, sink.path)
        name = f"{pack[0].first_id}-{uuid.uuid4().hex}"
        rows, files = _read(sink, spark, pack), -(-sum(u.size for u in pack) // file_bytes)
        # No shuffle: a task reads many small files and writes one.
        written = write_counted(rows.coalesce(max(1, files)), lambda out, name=name: out.write.parquet(sink.run_dir(name)))
        expected = sum(u.rows for u in pack)
        found = spark.read.schema(sink.schema).parquet(sink.run_dir(name)).count()
        # A lost count is no objection: the markers say what belongs into the run, the footers what is there.
        if found != expected or written not in (expected, None):
            raise BatchChanged(f"{expected} rows by the markers, {written} read, {found} found in the run {name}")
        owners: dict[str, list[int]] = {}
        for unit in pack:
            if unit.run:
                for owner, ranges in unit.run.owners.items():
                    owners.setdefault(owner, []).extend(i for a, b in ranges for i in range(a, b + 1))
            else:
                owners.setdefault(unit.marker.partition("\n")[0], []).append(unit.batch_id)
        run = mf.MergedRun(
            name, found, size_of(spark, sink.run_dir(name)), {o: mf.id_ranges(ids) for o, ids in owners.items()}
        )
        if before_publish:
            before_publish(sink.run_dir(name))
        changed = [u.batch_id for u in pack if u.marker and read_text(spark, sink.marker(u.batch_id)) != u.marker]
        if changed:
            raise BatchChanged(f"batches {changed} were written again meanwhile")
        mf.publish(spark, sink.path, current.with_runs([run], [u.run for u in pack if u.run]))
        log.info("merged %s batches and runs into %s: %s rows", len(pack), name, found)
        done.append(run)
    return done


def vacuum(sink: ParquetSink, spark: SparkSession, *, older_than_seconds: float = 86_400) -> int:
    """Remove directories and markers that merging has left, and unfinished runs; returns how many directories went.

    Only what no version of the manifest younger than `older_than_seconds`, nor the one current at that time, refers to:
    a reader that started later finds all its files.
    """
    limit = time.time() - older_than_seconds
    known = [m for v in mf.versions(spark, sink.path) if (m := mf.load_version(spark, sink.path, v))]
    old = [m for m in known if modified_at(spark, f"{mf.manifest_dir(sink.path)}/{m.version}") <= limit]
    if not old:
        return 0
    live = [m for m in known if m.version >= old[-1].version]
    removed = 0
    for batch_id in sink.directory_ids(spark):
        if all(m.run_of(batch_id) for m in live):
            delete(spark, sink.directory(batch_id))
            delete(spark, sink.marker(batch_id))
            removed += 1
    used = {run.name for m in live for run in m.runs}
    for name in child_names(spark, sink.runs_dir):
        if name not in used and modified_at(spark, sink.run_dir(name)) <= limit:
            delete(spark, sink.run_dir(name))
            removed += 1
    for m in known:
        if m.version < old[-1].version:
            delete(spark, f"{mf.manifest_dir(sink.path)}/{m.version}")
    return removed

