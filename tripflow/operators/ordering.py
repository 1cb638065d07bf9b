"""Numbers and running sums over a whole table in one order, without a task that sees it all.

Rows are sorted by range partitions and written down once, with their place in the partition. What comes before a partition
is then known from one row for each partition (and key): those are summed up, and joined to the rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.session import shared_dir

_ID, _RANGE, _PLACE, _BEFORE = "__id", "__range", "__place", "__before"


def _sorted(df: DataFrame, order: Sequence[str | Column], partitions: int | None) -> DataFrame:
    """`df` in range partitions, kept in the shared folder, since ranges drawn anew would cut elsewhere."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    path = shared_dir(df.sparkSession, "sorted")
    ranged.sortWithinPartitions(*order).withColumn(_ID, F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    # The id has the number of the partition above bit 33 and the place in it below.
    place = F.col(_ID).bitwiseAND((1 << 33) - 1)
    return rows.withColumns({_RANGE: F.shiftright(_ID, 33).cast("int"), _PLACE: place})


def with_global_number(
    df: DataFrame, order: Sequence[str | Column], *, out: str = "number", partitions: int | None = None
) -> DataFrame:
    """`df` with the place of each row in the whole order, from 1.

    Rows that are equal in all of `order` are numbered among themselves as they come, and stay in one partition; a column
    that tells them apart lets Spark split them.
    """
    rows = _sorted(df, order, partitions)
    sizes = rows.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    # One row for each partition.
    offsets = F.broadcast(sizes.select(_RANGE, F.coalesce(before, F.lit(0)).alias(_BEFORE)))
    numbered = rows.join(offsets, _RANGE).withColumn(out, F.col(_PLACE) + F.col(_BEFORE) + 1)
    return numbered.drop(_ID, _RANGE, _PLACE, _BEFORE)


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, out: str, partitions: int | None = None
) -> DataFrame:
    """`df` with the sum of `value` over the rows of equal `keys` up to each row in `order`, which should tell rows apart.

    A key with very many rows lies in many range partitions: each sums up its own part, and the totals of the parts before
    it are added. NULL values count as nothing, NULL keys are a key.
    """
    rows = _sorted(df, [*keys, *order], partitions)
    own = Window.partitionBy(_RANGE, *keys).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn(out, F.sum(F.coalesce(F.col(value), F.lit(0))).over(own))
    parts = rows.groupBy(_RANGE, *keys).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # Of a key one row for each partition that it lies in.
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    before = parts.select(
        F.col(_RANGE).alias("__part"), *(F.col(k).alias(n) for k, n in names.items()), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(_BEFORE)
    )
    same = [F.col(_RANGE) == F.col("__part"), *(F.col(k).eqNullSafe(F.col(n)) for k, n in names.items())]
    joined = summed.join(before, same).withColumn(out, F.col(out) + F.col(_BEFORE))
    return joined.drop(_ID, _RANGE, _PLACE, _BEFORE, "__part", *names.values())
