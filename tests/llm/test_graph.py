import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.llm import graph as module
from tripflow.llm.graph import audit, fit_centres, near_vectors, robust_prune

SCHEMA = "vec_id long, embedding array<float>"


def jittered(draw, x, spread):
    return x + spread * draw.normal(size=x.shape) * np.linalg.norm(x) / np.sqrt(len(x))


def brute(rows):
    """n_links and component of each id, and the number of links."""
    fine = [(i, np.array(e, np.float32).astype(float)) for i, e in rows if e is not None and None not in e and len(e)]
    fine = [(i, e) for i, e in fine if np.isfinite(e).all() and e.any()]
    ids = [i for i, _ in fine]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    counts = dict.fromkeys(root, 0)
    for size in {len(e) for _, e in fine}:
        ids = np.array([i for i, e in fine if len(e) == size])
        x = np.stack([e / np.linalg.norm(e) for _, e in fine if len(e) == size])
        for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True):
            if ids[a] != ids[b]:
                counts[int(ids[a])] += 1
                r, s = find(int(ids[a])), find(int(ids[b]))
                root[max(r, s)] = min(r, s)
    return {i: (counts[i], find(i)) for i in root}


def run(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"node": F.lit(1), "copies": F.lit("x")})
    found = near_vectors(table).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert len(found) == len({r.vec_id for r in found})
    return {r.vec_id: (r.n_links, r.component_id) for r in found}


@pytest.mark.parametrize("piece,hot", [(2_048, 700), (150, 300)])
def test_groups(spark, monkeypatch, piece, hot):
    monkeypatch.setattr(module, "PIECE_ROWS", piece)
    monkeypatch.setattr(module, "CENTRE_ROWS", 100)
    draw = np.random.default_rng(2)
    singles = [draw.normal(size=24) for _ in range(900)]
    groups = [jittered(draw, singles[k % 40], 0.08) for k in range(400)]
    # A third of all rows: one vector with little noise, and exact copies of another.
    groups += [jittered(draw, singles[50], 0.05) for _ in range(hot)] + [singles[51]] * 200
    rows = [(int(i), e.tolist()) for i, e in zip(draw.permutation(5_000), singles + groups, strict=False)]
    expected, got = brute(rows), run(spark, rows)
    assert got.keys() == expected.keys()
    assert all(got[i][0] <= expected[i][0] for i in got)
    true = sum(n for n, _ in expected.values())
    assert sum(n for n, _ in got.values()) >= 0.99 * true > 0
    assert sum(got[i][1] == expected[i][1] for i in got) >= 0.99 * len(got)


def test_at_the_border(spark, monkeypatch):
    """Pairs at a cosine of 0.95 to 0.97 among unrelated vectors."""
    monkeypatch.setattr(module, "CENTRE_ROWS", 64)
    draw = np.random.default_rng(5)
    rows = []
    for i in range(700):
        x, y = draw.normal(size=(2, 64))
        y -= (y @ x) / (x @ x) * x
        c = draw.uniform(0.94, 0.97)
        rows.append((2 * i, x.tolist()))
        z = c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * y / np.linalg.norm(y)
        rows.append((2 * i + 1, z.tolist()))
    expected, got = brute(rows), run(spark, rows)
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in expected.values()) > 500


def test_odd_rows(spark):
    x = [1.0, 2.0, 3.0]
    rows = [(1, x), (2, [2.0, 4.0, 6.0]), (3, x), (4, None), (5, []), (6, [0.0] * 3), (7, [1.0, None, 3.0]), (8, [float("nan")] * 3)]
    rows += [(9, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [1e30, 2e30, 3e30]), (13, [-1.0, -2.0, -3.0])]
    rows += [(14, [1e-40, 2e-40, 3e-40])]
    expected = brute(rows)
    expected[14] = (4, 1)  # denormal, of the same direction
    for i in (1, 2, 3, 12):
        expected[i] = (4, 1)
    assert run(spark, rows) == expected
    table = spark.createDataFrame([(None, x), (1, x), (1, x), (2, x)], SCHEMA)
    got = sorted(map(tuple, near_vectors(table).collect()), key=repr)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)]


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    got = near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_audit_and_rebuild(spark, monkeypatch, caplog):
    """Lists that lead nowhere lose links; the audit sees it and the overlap is raised."""
    draw = np.random.default_rng(1)
    x = [draw.normal(size=16) for _ in range(300)]
    rows = [(i, jittered(draw, x[i % 300], 0.02).tolist()) for i in range(900)]
    monkeypatch.setattr(module, "CENTRE_ROWS", 50)
    monkeypatch.setattr(module, "TARGET_RECALL", 1.01)
    monkeypatch.setattr(module, "OVERLAPS", (1, 2))
    with caplog.at_level(logging.INFO, logger=module.__name__):
        run(spark, rows)
    assert "overlap of 1 shards" in caplog.text and "overlap of 2 shards" in caplog.text
    nodes = spark.createDataFrame(
        [(i, np.array(e, "<f8").tobytes(), 1) for i, e in ((1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]))],
        "node long, vector binary, copies long",
    )
    none = spark.createDataFrame([], "node long, n long")
    half = spark.createDataFrame([(1, 1)], "node long, n long")
    assert audit(nodes, none, 3) == 0.0 and audit(nodes, half, 3) == 0.5


def test_pruned_lists():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = robust_prune(x)
    assert len(lists) == 500 and max(map(len, lists)) <= module.NEIGHBOURS + module.FAR + module.REVERSE
    nearest = (x @ x.T - 2 * np.eye(500)).argmax(1)
    assert all(nearest[i] in lists[i] and i not in lists[i] for i in range(500))
    assert [len(found) for found in robust_prune(x[:1])] == [0]


def test_centres_lie_apart():
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(size=(50, 8)), 1 + 0.01 * draw.normal(size=(300, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = fit_centres(x, 20)
    assert (np.tril(centres @ centres.T, -1) < module.SEPARATION).all() and 1 < len(centres) <= 20
