import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.llm import topk
from tripflow.llm.topk import nearest, top_k

SCHEMA = "vec_id long, embedding array<float>"


END = (1 << 63) - (1 << 10)


def plain(rows, queries, k=5):
    whole = {}
    fine = []
    for i, e in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e):
            fine.append((i, [min(max(int(np.floor(256 * x)), -END), END) for x in np.array(e, np.float32).astype(float)]))
            whole.setdefault(i, fine[-1][1])
    found = []
    for q in sorted({i for i, _ in fine if queries(i)}):
        found_in = [(i, x) for i, x in fine if i != q and len(x) == len(whole[q])]
        dots = [(sum(a * b for a, b in zip(whole[q], x, strict=True)), i) for i, x in found_in]
        scored = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in dots)[:k]
        found += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(found)


def vectors(n, seed, hot=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * draw.normal(size=8)).astype(float).tolist()) for i in range(n)]
    return rows + [(10_000 + i, rows[0][1]) for i in range(hot)]


@pytest.mark.parametrize("hot", [0, 3_000])
def test_against_all(spark, hot):
    rows = vectors(1_500, 1, hot)
    rows += [(60_000, None), (60_050, [1.0] * 7 + [None]), (60_100, [float("nan")] * 8), (60_150, [float("inf")] * 8)]
    rows += [(60_200, [1.0] * 3), (60_250, []), (None, [1.0] * 8), (60_300, [0.0] * 8), (60_350, [-1e9] * 8), (7, rows[7][1])]
    rows += [(60_400, [300_000.0, 1.0] + [0.0] * 6), (60_450, [3.0, 2.0, 1.0]), (60_451, [1.0, 2.0, 2.0]), (60_452, [-1.0] * 3)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"score": F.lit(1), "pivot": F.lit("x")})
    got = sorted(map(tuple, nearest(table).collect()))
    assert got == plain(rows, lambda i: i % 50 == 0)


def test_few_rows(spark):
    rows = vectors(4, 2)
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, top_k(table, table).collect())) == plain(rows, lambda i: True)
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert nearest(one).collect() == []


def test_large_components(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).integers(-200_000, 200_000, 8)]) for i in range(120)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, nearest(table).collect())) == plain(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("size", [2.0**25, 2.0**40, 1e30, 3e38])
def test_beyond_doubles_and_longs(spark, size):
    draw = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in size * draw.uniform(-1, 1, 8)]) for i in range(150)]
    rows += [(1_000 + i, [float(v) for v in draw.uniform(-1, 1, 8)]) for i in range(100)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, nearest(table).collect())) == plain(rows, lambda i: i % 50 == 0)


def test_small_annuli(spark, monkeypatch):
    """Many annuli and regions; neighbours are found in few of them."""
    monkeypatch.setattr(topk, "CHUNK_ROWS", 20)
    monkeypatch.setattr(topk, "REGION_CHUNKS", 3)
    rows = vectors(900, 8)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, nearest(table).collect())) == plain(rows, lambda i: i % 50 == 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nearest(none).collect() == []
    assert nearest(spark.createDataFrame([(1, None), (50, [None])], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [1.0, 2.0**25, 1e30])
def test_bound_holds(size):
    draw = np.random.default_rng(4)
    x, q = np.floor(256 * size * draw.normal(size=(500, 8))), np.floor(256 * size * draw.normal(size=(40, 8)))
    pivots = topk.Pivots(x[:100], float((x**2).sum(1).max()))
    to, of = pivots.distances(pivots.lift(x)), pivots.of_queries(q)
    pruned = 0
    for rows in np.array_split(to[:, 0].argsort(), 50):
        best = pivots.best_score(q, of, to[rows].min(0), to[rows].max(0))
        assert (best >= (q @ x[rows].T).max(1)).all()
        pruned += (best < np.sort(q @ x.T, axis=1)[:, -5]).sum()
    assert pruned > 0
    for row in range(0, 500, 10):
        assert (pivots.best_score(q, of, to[row], to[row]) >= q @ x[row]).all()
