"""Sketches stored beside the batches of a parquet sink: distinct counts and quantiles of all of it without reading it.

Each batch gets one row with a HyperLogLog sketch for each column whose distinct values are asked for, and a KLL sketch
for each whose quantiles are. Sketches of batches merge into one of the whole, a few kilobytes each, so an estimate costs a
row for each batch however large they are. Needs Spark 4.1.
"""

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.schema import BATCH_ID
from tripflow.sinks.parquet import ParquetSink
from tripflow.sources.files import child_names, exists

# 2^12 registers: a standard error of 1.6 %; a quantile's rank is off by 1.7 % at most, with 99 % certainty.
LOG_REGISTERS, KLL_SIZE = 12, 200
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2), 0.017


def _stored(sink: ParquetSink, spark: SparkSession) -> DataFrame | None:
    """The sketches of all batches; what a driver left unfinished is passed over."""
    folder = f"{sink.path}/_sketches"
    whole = [f"{folder}/{name}" for name in child_names(spark, folder) if exists(spark, f"{folder}/{name}/_SUCCESS")]
    return spark.read.parquet(*whole).dropDuplicates([BATCH_ID]) if whole else None


def sketch_batches(
    sink: ParquetSink, spark: SparkSession, *, distinct: Sequence[str] = (), quantiles: Sequence[str] = ()
) -> int:
    """Sketch the batches that have none yet, the given columns of each; returns how many there were.

    The columns should be the same each time. One pass over the new batches; sketches are made where the rows are and only
    they are shuffled. A batch that is replaced later keeps its old sketch.
    """
    known = _stored(sink, spark)
    done = set() if known is None else {r[0] for r in known.select(BATCH_ID).collect()}
    new = [i for i in sink.batch_ids(spark) if i not in done]
    if not new:
        return 0
    # One id for each new batch.
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in new], f"{BATCH_ID} int"))
    rows = sink.read(spark).join(wanted, BATCH_ID, "left_semi")
    sketches = [F.hll_sketch_agg(c, F.lit(LOG_REGISTERS)).alias(f"distinct {c}") for c in distinct]
    sketches += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_SIZE)).alias(f"quantile {c}") for c in quantiles]
    found = rows.groupBy(BATCH_ID).agg(F.count(F.lit(1)).alias("rows"), *sketches)
    found.write.parquet(f"{sink.path}/_sketches/{uuid.uuid4().hex}")
    return len(new)


def estimates(
    sink: ParquetSink, spark: SparkSession, *, distinct: Sequence[str] = (), quantiles: Mapping[str, Sequence[float]] | None = None
) -> DataFrame:
    """One row: `rows`, `distinct <column>` for each of `distinct`, and `quantile <column>`, a list, for each of `quantiles`.

    Of all batches sketched so far; without any, no row.
    """
    quantiles = quantiles or {}
    found = _stored(sink, spark)
    if found is None:
        columns = [f"`distinct {c}` long" for c in distinct] + [f"`quantile {c}` array<double>" for c in quantiles]
        return spark.createDataFrame([], ", ".join(["rows long", *columns]))
    merged = found.agg(
        F.sum("rows").alias("rows"),
        *(F.hll_union_agg(f"distinct {c}").alias(f"distinct {c}") for c in distinct),
        *(F.kll_merge_agg_double(f"quantile {c}").alias(f"quantile {c}") for c in quantiles),
    )
    ranks = {c: F.array(*map(F.lit, map(float, q))) for c, q in quantiles.items()}
    return merged.select(
        "rows",
        *(F.hll_sketch_estimate(f"distinct {c}").alias(f"distinct {c}") for c in distinct),
        *(F.kll_sketch_get_quantile_double(f"quantile {c}", ranks[c]).alias(f"quantile {c}") for c in quantiles),
    )
