"""Mixing sources to target weights by Pfair scheduling of blocks, earliest deadline first.

Each source's documents, in an order drawn from their hashes, are cut into blocks of `block_rows`. With weight w of
W, block j of a source is released at slot floor(j*W/w) and due before slot ceil((j+1)*W/w); each slot goes to the
released block with the earliest deadline, the heavier source and then the name deciding ties. The weights add up to
one block a slot, so no deadline is missed: after any number of slots each source has had its share but for less
than one block.

The weights are whole numbers, so the schedule repeats every W slots. One period is laid out once, by the weights
alone, whatever the amount of data; the slot of every block then follows from its number. A source that has run out
leaves its slots empty; `in_mix` marks the blocks up to there, where all proportions hold. No document is dropped.

Every source has a weight, blocks and deadlines of its own, however many there are. Up to GROUPS sources are scheduled
side by side. Of more, the heavier ones are, and the others share groups, drawn by a hash of their names: the groups are
scheduled side by side, and the blocks of a group in the same way among its members, one task for each group. A member of
a group is then off by less than two blocks, as the group may be off by one and the member within it by another.

Without given weights a source's weight is its number of documents to the power of `TEMPERATURE`, scaled so that all add
up to RESOLUTION, or SHARE for each source if that is more, and at least one. Null sources are a source by themselves, as are empty names; sources without a weight, or with none
above zero, have no slot (null) and are not in the mix. Rows are ordered by a hash of id and text, repeated rows stay beside each other, an
empty table stays empty, and other columns are kept as they are.
"""

from collections.abc import Mapping
from fractions import Fraction
from functools import reduce
from heapq import heappop, heappush
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import checkpointed, written

BLOCK_ROWS = 100
TEMPERATURE = 0.5
RESOLUTION, SHARE = 1_000, 16
# What the driver lays out: so many sources or groups of them, and a period of at most SHARE slots for each.
GROUPS = 32_768
# Rows of a source that one task numbers, about; a source is cut into some parts in any case.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 64


def period(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline first."""
    shared = reduce(gcd, weights.values())
    weights = {s: w // shared for s, w in sorted(weights.items())}
    total = sum(weights.values())
    released: list[list[tuple]] = [[] for _ in range(total + 1)]
    for s, w in weights.items():
        released[0].append((-(-total // w), -w, s, 0))
    due: list[tuple] = []
    slots = []
    for slot in range(total):
        for block in released[slot]:
            heappush(due, block)
        _, minus, s, j = heappop(due)
        slots.append(s)
        j, w = j + 1, -minus
        if j < w:
            following = (-(-(j + 1) * total // w), -w, s, j)
            # Released later, or already.
            if j * total // w > slot:
                released[j * total // w].append(following)
            else:
                heappush(due, following)
    return slots


def deviation(slots: list[str], weights: Mapping[str, int]) -> Fraction:
    """The furthest that any source gets from its share after any number of slots, in blocks."""
    total = sum(weights.values())
    done, worst = dict.fromkeys(weights, 0), Fraction(0)
    for n, s in enumerate(slots, 1):
        done[s] += 1
        worst = max(worst, *(abs(Fraction(n * w, total) - done[x]) for x, w in weights.items()))
    return worst


def _name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("\x00null"))


def target_weights(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """`s`, the name of each source, and `w`, its weight as a whole number."""
    counts = docs.groupBy(_name(F.col(source_col)).alias("s")).agg(F.count("*").alias("n"))
    counts = written(counts.select("s", F.pow("n", F.lit(TEMPERATURE)).alias("x")), "sources")
    n, x = counts.agg(F.count("*"), F.sum("x")).first()
    scale = max(RESOLUTION, SHARE * n) / x if n else 0.0
    return counts.select("s", F.greatest(F.round(F.col("x") * scale).cast("long"), F.lit(1).cast("long")).alias("w"))


def _places(slots: list[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for slot, s in enumerate(slots):
        places.setdefault(s, []).append(slot)
    return places


def _members(table: pa.Table) -> pa.Table:
    """The members of a group, with weights, to their places in the group's period and its length."""
    weights = dict(zip(table["s"].to_pylist(), table["w"].to_pylist(), strict=True))
    slots = period(weights)
    places = _places(slots)
    names = list(places)
    return pa.table(
        {
            "s": pa.array(names, pa.string()),
            "g": pa.array([table["g"][0].as_py()] * len(names), pa.string()),
            "inner": pa.array([places[s] for s in names], pa.list_(pa.int64())),
            "inner_length": pa.array([len(slots)] * len(names), pa.int64()),
        }
    )


def layout(weights: DataFrame) -> tuple[DataFrame, int]:
    """`s`, its places in the period of its group and that one's length, the group's places; and the length of the period."""
    spark = weights.sparkSession
    weights = written(weights.where("w > 0"), "weights")
    if weights.count() <= GROUPS:
        grouped = weights.withColumn("g", F.concat(F.lit("s"), "s"))
    else:
        # At most half of GROUPS rows.
        heavy = F.broadcast(weights.orderBy(F.desc("w"), "s").limit(GROUPS // 2).select("s", F.lit(True).alias("own")))
        drawn = F.concat(F.lit("g"), F.pmod(F.xxhash64("s"), F.lit(GROUPS // 2)).cast("string"))
        grouped = weights.join(heavy, "s", "left").select("s", "w", F.when(F.col("own"), F.concat(F.lit("s"), "s")).otherwise(drawn).alias("g"))
    inner = grouped.groupBy("g").applyInArrow(_members, "s string, g string, inner array<long>, inner_length long")
    # At most GROUPS rows.
    totals = {r.g: r.w for r in grouped.groupBy("g").agg(F.sum("w").alias("w")).collect()}
    if not totals:
        return inner.withColumn("places", F.lit(None).cast("array<long>")), 1
    most = max(RESOLUTION, SHARE * len(totals))
    whole = sum(totals.values()) // reduce(gcd, totals.values())
    if whole > 2 * most:
        totals = {g: max(1, round(w * most / sum(totals.values()))) for g, w in totals.items()}
    slots = period(totals)
    outer = spark.createDataFrame(list(_places(slots).items()), "g string, places array<long>")
    return inner.join(F.broadcast(outer), "g"), len(slots)


def _slot(block: Column, length: int) -> Column:
    """The slot of a source's block, by its number: first among the blocks of its group, then among all."""

    def place(k: Column, places: str, period_length: Column) -> Column:
        n = F.size(places)
        return F.floor(k / n) * period_length + F.element_at(places, (k % n + 1).cast("int"))

    return place(place(block, "inner", F.col("inner_length")), "places", F.lit(length))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, int] | DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with `mix_block`, `mix_slot`, `mix_row` (row in the block) and `in_mix`; by slot and row it is in order.

    `weights` are whole numbers by source, or a table of them (`s`, `w`). Columns of `docs` with these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_row", "in_mix")
    if weights is None:
        weights = target_weights(docs, source_col)
    elif not isinstance(weights, DataFrame):
        weights = spark.createDataFrame(list(weights.items()), "s string, w long")
    plan, length = layout(weights)
    plan = written(plan.select("s", "inner", "inner_length", "places"), "mix-layout")

    name = _name(F.col(source_col))
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    buckets = max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    # The row travels as one column, so that its names can't clash with those used here.
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        name.alias("s"),
        order.alias("o"),
        F.pmod(order, F.lit(buckets)).alias("b"),
        F.col(id_col).alias("id"),
    )
    # A hash bucket of a source is numbered by one task; its first number follows from the sizes of those before it.
    sizes = docs.select(name.alias("s"), F.pmod(order, F.lit(buckets)).alias("b")).groupBy("s", "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = checkpointed(sizes.select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n"))
    within = Window.partitionBy("s", "b").orderBy("o", F.col("id").asc_nulls_first())
    numbered = (
        keyed.withColumn("k", F.row_number().over(within) - 1)
        .join(firsts.drop("n"), ["s", "b"])
        .withColumn("k", F.col("k") + F.col("first"))
        .withColumn("block", F.floor(F.col("k") / block_rows))
    )
    # Up to the first empty slot every source has its share.
    totals = plan.join(firsts.groupBy("s").agg(F.sum("n").alias("n")), "s", "left")
    next_block = F.ceil(F.coalesce(F.col("n"), F.lit(0)) / block_rows).cast("long")
    horizon = totals.agg(F.min(_slot(next_block, length))).first()[0]
    slot = _slot(F.col("block"), length)
    return numbered.join(plan, "s", "left").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns],
        F.col("block").cast("long").alias("mix_block"),
        slot.cast("long").alias("mix_slot"),
        (F.col("k") % block_rows).cast("long").alias("mix_row"),
        F.coalesce(slot < F.lit(horizon), F.lit(False)).alias("in_mix"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """`doc_id`, `source`, `mix_block`, `mix_slot`, `mix_row`, `in_mix`: a row for each row."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("text"),
    )
    return mixed(narrow).drop("text")
