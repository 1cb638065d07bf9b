"""Joining rows whose times overlap, without comparing all with all.

Time is cut into cells. A row belongs to a level by its length, 2^level cells of the least length, so that it lies in two
cells of its level at most. Of each level that occurs a row takes part in the levels from its own upward, in the cells
that it touches there. Two rows meet in the cell of the longer one's level that holds the later of the two starts, and in
no other: each pair comes once. A cell with very many rows is split: its left rows are dealt over parts and its right rows
copied to each. Where no cell is that full, both sides are placed alike, and Spark shuffles a table that is joined with
itself once.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_SECONDS = 3_600
# Left rows of a cell that are compared in one part.
PART_ROWS = 10_000
# Longer rows share the last level, with cells of 2^20 hours, some 120 years.
MOST_LEVEL = 20

_LEVEL, _OWN, _CELL, _PART, _PARTS = "__level", "__own", "__cell", "__part", "__parts"


def _seconds(time: str | Column) -> Column:
    return F.unix_micros(time) / 1e6


def _cell(seconds: Column, level: Column, cell_seconds: int) -> Column:
    return F.floor(seconds / (F.lit(cell_seconds) * F.pow(F.lit(2.0), level))).cast("long")


def _timed(df: DataFrame, start: str, end: str, cell_seconds: int) -> DataFrame:
    """Rows with a duration, and their level."""
    cells = (_seconds(end) - _seconds(start)) / cell_seconds
    level = F.least(F.greatest(F.ceil(F.log2(cells)), F.lit(0)), F.lit(MOST_LEVEL)).cast("int")
    return df.where(F.unix_micros(end) > F.unix_micros(start)).withColumn(_LEVEL, level)


def _placed(df: DataFrame, start: str, end: str, levels: list[int], cell_seconds: int) -> DataFrame:
    """A row for each cell that a row touches, at its own level and the longer ones that occur, less its two times."""
    at = df.withColumn(_OWN, F.col(_LEVEL)).withColumn(_LEVEL, F.explode(F.array(*map(F.lit, levels))))
    at = at.where(F.col(_LEVEL) >= F.col(_OWN)).withColumn(_OWN, F.col(_LEVEL) == F.col(_OWN))
    first, last = (_cell(_seconds(c), F.col(_LEVEL), cell_seconds) for c in (start, end))
    return at.withColumn(_CELL, F.explode(F.sequence(first, last))).drop(start, end)


def _split(left: DataFrame, right: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The left rows of the `hot` cells dealt over their parts, the right ones copied to each; the others in part 0."""
    # There is at most one hot cell for each `part_rows` placed rows, so the list of them goes to the rows.
    parted = (df.join(F.broadcast(hot), keys, "left").withColumn(_PARTS, F.coalesce(_PARTS, F.lit(1))) for df in (left, right))
    dealt, copied = parted
    dealt = dealt.withColumn(_PART, F.pmod(F.xxhash64("l"), F.col(_PARTS)).cast("int"))
    copied = copied.withColumn(_PART, F.explode(F.sequence(F.lit(0), F.col(_PARTS) - 1)))
    return dealt.drop(_PARTS), copied.drop(_PARTS)


def join_overlapping(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str],
    start: str,
    end: str,
    cell_seconds: int = CELL_SECONDS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """`l` and `r`, a struct of each side, for all pairs of equal `on` that share a moment: from `start` to before `end`.

    Rows without one of the two times or of no or negative duration overlap with nothing; a NULL key equals none.
    """
    # The pairs' times are taken from the two structs, so that no row carries them twice.
    sides = [
        _timed(df.select(F.struct(*df.columns).alias(name), *on, start, end), start, end, cell_seconds)
        for name, df in (("l", left), ("r", right))
    ]
    found = {r[0] for df in sides for r in df.select(_LEVEL).distinct().collect()}  # at most MOST_LEVEL + 1
    if not found:
        found = {0}
    placed = [_placed(df, start, end, sorted(found), cell_seconds) for df in sides]
    keys = [*on, _LEVEL, _CELL]
    sizes = placed[0].groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > part_rows)
    hot = sizes.select(*keys, F.ceil(F.col("__n") / part_rows).cast("int").alias(_PARTS))
    if not hot.isEmpty():
        placed, keys = _split(*placed, hot, keys), [*keys, _PART]
    a, b = (df.alias(name) for df, name in zip(placed, "ab", strict=True))
    # Written so that both sides give the start first: columns in another order would be another shuffle.
    later = F.greatest(f"l.{start}", f"r.{start}")
    overlap = later < F.least(f"l.{end}", f"r.{end}")
    here = (F.col(f"a.{_OWN}") | F.col(f"b.{_OWN}")) & (_cell(_seconds(later), F.col(f"a.{_LEVEL}"), cell_seconds) == F.col(f"a.{_CELL}"))
    condition = overlap & here
    for c in keys:
        condition = condition & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    # The side that is not split may be large, so neither is broadcast but by Spark's own measure.
    return a.join(b, condition).select("l", "r")
