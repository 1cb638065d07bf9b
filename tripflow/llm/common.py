"""What the training-data operators share: reading texts, writing down intermediate tables, logistic fits."""

import tempfile
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as `doc_id` and `text`; whatever else the table holds can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder that `spark.checkpoint.dir` names, so that lost executors cost no re-run.

    Where the setting is absent, as in tests, a folder of this process serves.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        context.setCheckpointDir(folder or _local_folder())
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` as a parquet table in the shared folder: smaller than a checkpoint, and read column by column."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tripflow-llm-")


def id_texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """Ids and UTF-8 texts of a batch whose first columns are `doc_id` and `text`; a null text counts as empty."""
    raw = batch.column(1).cast(pa.binary())
    for doc_id, text in zip(batch.column(0).to_pylist(), raw, strict=True):
        yield doc_id, text.as_py() or b""


def held_out(id_col: str, folds: int, fold: int):
    """Whether the crc32 of the id's decimal text falls into the fold kept from learning; null ids do not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, keep: "F.Column", per_class: tuple[int, int]
) -> DataFrame:
    """At most `per_class[k]` documents with label k, chosen by a hash of the id: `doc_id`, `text`, `label`.

    A document labelled twice counts with its larger label, one with several texts by the least of them; `keep` tells by
    `doc_id` which may be learned from.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
    )
    chosen = [
        known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for k, n in enumerate(per_class)
    ]
    # At most sum(per_class) ids, so the broadcast is bounded.
    ids = F.broadcast(checkpointed(chosen[0].unionByName(chosen[1])))
    return docs.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


FOLDS = 3


def fold_of(doc_id: int) -> int:
    """The fold of a labelled text: what a model built from the other folds says of it calibrates the final model."""
    return (zlib.crc32(str(doc_id).encode()) >> 8) % FOLDS


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept first, by Newton's method. Without both classes: the base rate."""
    x = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w
        )
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(w: np.ndarray, *features: float) -> float:
    z = float(w[0]) + sum(float(a) * b for a, b in zip(w[1:], features, strict=True))
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
