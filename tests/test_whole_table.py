import random

import pytest
from pyspark.sql import functions as F

from tripflow import operators as op
from tripflow.operators import intervals

SPAN = "id int, k int, s timestamp, e timestamp"


def spans(spark, rows):
    table = spark.createDataFrame([(i, k, a, b) for i, k, a, b in rows], "id int, k int, s double, e double")
    return table.withColumns({c: F.timestamp_micros((F.col(c) * 1e6).cast("long")) for c in ("s", "e")})


def brute(left, right):
    return sorted(
        (i, j)
        for i, k, a, b in left
        for j, m, c, d in right
        if None not in (k, m, a, b, c, d) and k == m and a < b and c < d and a < d and c < b
    )


def pairs(spark, left, right, **how):
    found = op.join_overlapping(spans(spark, left), spans(spark, right), on=["k"], start="s", end="e", **how)
    return sorted((r.l.id, r.r.id) for r in found.collect())


def drawn(seed, n):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        # From seconds to weeks, some ends on the edges of cells.
        length = draw.choice([10, 600, 3_600, 7_200, 90_000, 2_000_000])
        start = draw.choice([draw.uniform(-1e5, 1e6), 3_600.0 * draw.randrange(200)])
        rows.append((i, draw.randrange(3), start, start + draw.choice([length, draw.uniform(0, length)])))
    return rows + [(n, 1, None, 5.0), (n + 1, 1, 5.0, None), (n + 2, 1, 50.0, 50.0), (n + 3, 1, 60.0, 50.0), (n + 4, None, 1.0, 9e5)]


@pytest.mark.parametrize("part_rows", [10_000, 3])
def test_overlaps(spark, part_rows):
    left, right = drawn(1, 150), drawn(2, 150)
    got = pairs(spark, left, right, part_rows=part_rows)
    assert got == brute(left, right) and len(got) > 500


def test_overlaps_of_a_hot_hour(spark):
    """A third of the rows in one hour: no nested loop in the plan, and the cell in parts."""
    rows = [(i, 0, 1_000.0 + i % 60, 1_500.0 + i % 7) for i in range(120)] + drawn(3, 200)
    left = spans(spark, rows)
    found = op.join_overlapping(left, left, on=["k"], start="s", end="e", part_rows=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.l.id, r.r.id) for r in found.collect()) == brute(rows, rows)


def test_touching_and_century_long(spark):
    long = (1, 0, 0.0, 4e9)
    rows = [long, (2, 0, 10.0, 20.0), (3, 0, 20.0, 30.0), (4, 0, 3.9e9, 3.9e9 + 1)]
    assert pairs(spark, rows, rows) == brute(rows, rows)
    assert (2, 3) not in brute(rows, rows) and intervals.MOST_LEVEL == 20


def test_overlaps_of_empty_tables(spark):
    assert pairs(spark, [], []) == [] == pairs(spark, [(1, 1, None, None)], [(1, 1, 1.0, 2.0)])


@pytest.mark.parametrize("part_rows, shuffles, joins", [(10_000, 1, 1), (3, 3, 1)])
def test_rows_are_shuffled_once(spark, tmp_path, part_rows, shuffles, joins):
    """Full cells are looked up where the rows are; a table joined with itself is shuffled for one side."""
    rows = drawn(6, 200)
    spans(spark, rows).write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = op.join_overlapping(table, table, on=["k"], start="s", end="e", part_rows=part_rows)
        found = found.select("l.id", F.col("r.id").alias("other"))
        assert sorted(map(tuple, found.collect())) == brute(rows, rows)
        plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(dealt) == shuffles and plan.count("SortMergeJoin") == joins
    # Of the times only those of the struct go with a row.
    assert not any(name in plan for name in ("__from", "__to"))


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_numbers(spark, partitions):
    draw = random.Random(4)
    values = [draw.choice([None, 1, 2, 2, 2, draw.randrange(99)]) for _ in range(700)]
    table = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(5)
    got = op.with_global_number(table, [F.desc_nulls_last("v"), "id"], out="n", partitions=partitions)
    assert got.columns == ["id", "v", "n"]
    expected = sorted(enumerate(values), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.v) for r in sorted(got.collect(), key=lambda r: r.n)] == expected
    assert sorted(r.n for r in got.collect()) == list(range(1, 701))


def test_numbers_of_equal_rows_and_none(spark):
    same = spark.createDataFrame([(7,)] * 90, "v int")
    assert sorted(r.number for r in op.with_global_number(same, ["v"]).collect()) == list(range(1, 91))
    assert op.with_global_number(same.limit(0), ["v"]).collect() == []


@pytest.mark.parametrize("partitions", [1, 9])
def test_running_totals(spark, partitions):
    draw = random.Random(5)
    # One key has most rows; there are null keys and null values.
    rows = [(draw.choice([1, 1, 1, 2, None]), i, draw.choice([None, draw.randrange(10)])) for i in range(600)]
    table = spark.createDataFrame(rows, "k int, i int, v int").repartition(4)
    got = op.with_running_total(table, ["k"], ["i"], "v", out="t", partitions=partitions)
    assert got.columns == ["k", "i", "v", "t"]
    totals, expected = {}, []
    for k, i, v in rows:
        totals[k] = totals.get(k, 0) + (v or 0)
        expected.append((i, totals[k]))
    assert sorted((r.i, r.t) for r in got.collect()) == expected


def test_a_hot_key_is_split(spark):
    table = spark.range(5_000).selectExpr("1 AS k", "id AS i", "1 AS v")
    rows = op.with_running_total(table, ["k"], ["i"], "v", out="t", partitions=8)
    assert rows.where("t <> i + 1").count() == 0
    from tripflow.operators.ordering import _RANGE, _sorted

    sizes = [r["count"] for r in _sorted(table, ["k", "i"], 8).groupBy(_RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1_500


def test_reconcile(spark):
    schema = "a int, b string"
    landed = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, ""), (None, "n"), (4, "same"), (4, "same")], schema)
    stored = spark.createDataFrame([(1, "x"), (2, None), (2, None), (3, None), (None, "n"), (4, "same"), (4, "same")], schema)
    got = op.reconcile(landed, stored.withColumn("landed", F.lit(9)), ["a", "b"])
    assert got.columns == ["a", "b", "landed", "stored"]
    found = sorted((r.a, str(r.b), r.landed, r.stored) for r in got.collect())
    assert found == [(1, "x", 2, 1), (2, "None", 1, 2), (3, "", 1, 0), (3, "None", 0, 1)]
    assert op.reconcile(landed, landed, ["a", "b"]).count() == 0
    assert op.reconcile(landed.limit(0), landed.limit(0), ["a"]).count() == 0
