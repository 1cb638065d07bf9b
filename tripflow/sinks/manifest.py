"""Which batches of a parquet sink have been merged into runs, as a series of small versioned files.

A run is a directory that holds many batches, their ids among the columns. Version n + 1 of the manifest is made by
creating a file of that name, which only one writer can do; readers take the highest version that is complete, so a
writer that dies over it changes nothing.
"""

import json
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

from tripflow.sources.files import child_names, create_text, read_text

_VERSION = re.compile(r"\d+")
_END = "end"


class StaleManifest(RuntimeError):
    """Another writer has published a version in the meantime."""


def id_ranges(ids: list[int]) -> list[list[int]]:
    """Ids as ranges, both ends included."""
    found: list[list[int]] = []
    for i in sorted(ids):
        if found and found[-1][1] == i - 1:
            found[-1][1] = i
        else:
            found.append([i, i])
    return found


@dataclass(frozen=True)
class MergedRun:
    """`owners` has the ranges of batch ids by stream; `dropped` ids have been replaced since and don't count."""

    name: str
    rows: int
    size: int
    owners: dict[str, list[list[int]]]
    dropped: tuple[int, ...] = ()

    def owner_of(self, batch_id: int) -> str | None:
        if batch_id in self.dropped:
            return None
        held = (o for o, ranges in self.owners.items() if any(a <= batch_id <= b for a, b in ranges))
        return next(held, None)

    @property
    def first_id(self) -> int:
        return min(a for ranges in self.owners.values() for a, _ in ranges)

    @property
    def last_id(self) -> int:
        return max(b for ranges in self.owners.values() for _, b in ranges)

    def batch_ids(self) -> list[int]:
        ids = (i for ranges in self.owners.values() for a, b in ranges for i in range(a, b + 1))
        return sorted(i for i in ids if i not in self.dropped)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    runs: tuple[MergedRun, ...] = ()

    def run_of(self, batch_id: int) -> MergedRun | None:
        return next((run for run in self.runs if run.owner_of(batch_id) is not None), None)

    def with_runs(self, new: list[MergedRun], gone: list[MergedRun]) -> "Manifest":
        names = {run.name for run in gone}
        kept = [run for run in self.runs if run.name not in names]
        return Manifest(self.version + 1, tuple(sorted([*kept, *new], key=lambda run: run.first_id)))

    def without_batch(self, batch_id: int) -> "Manifest":
        """The batch is read from its own directory again."""
        run = self.run_of(batch_id)
        return self.with_runs([replace(run, dropped=(*run.dropped, batch_id))], [run])


def manifest_dir(path: str) -> str:
    # Spark passes over names that begin with an underscore.
    return f"{path}/_manifest"


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name in child_names(spark, manifest_dir(path)) if _VERSION.fullmatch(name))


def load_version(spark: SparkSession, path: str, version: int) -> Manifest | None:
    """That version, or None if it is not complete."""
    lines = (read_text(spark, f"{manifest_dir(path)}/{version}") or "").splitlines()
    if not lines or lines[-1] != _END:
        return None
    runs = (json.loads(line) for line in lines[:-1])
    return Manifest(version, tuple(MergedRun(**run | {"dropped": tuple(run["dropped"])}) for run in runs))


def load(spark: SparkSession, path: str) -> Manifest:
    """The newest complete version; an incomplete one above it keeps its number."""
    found = versions(spark, path)
    for version in reversed(found):
        manifest = load_version(spark, path, version)
        if manifest is not None:
            return replace(manifest, version=found[-1])
    return Manifest(found[-1] if found else 0)


def publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make `manifest` the current version, unless another writer was faster."""
    text = "\n".join([*(json.dumps(asdict(run)) for run in manifest.runs), _END])
    if not create_text(spark, f"{manifest_dir(path)}/{manifest.version}", text):
        raise StaleManifest(f"version {manifest.version} of {manifest_dir(path)} is taken")
