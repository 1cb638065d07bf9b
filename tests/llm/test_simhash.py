import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from llm.texts import prose

from tripflow.llm.components import connected_components
from tripflow.llm.simhash import fingerprint, one_of_each, simhash


def plain_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows: list[tuple]) -> dict:
    prints = sorted({plain_fingerprint(t) for _, t in rows})
    group = {f: f for f in prints}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                group[root(a)] = root(b)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root(plain_fingerprint(t))
            least[r] = min(least.get(r, i), i)
    return {f: least.get(root(f)) for f in prints}


def edited(text: str, seed: int, share: float) -> str:
    draw = random.Random(seed)
    return " ".join(f"x{draw.randrange(9)}" if draw.random() < share else w for w in text.split(" "))


def test_brute_force(docs):
    base = [prose(k, 300) for k in range(20)]
    texts = base + [edited(t, 100 * k + j, 0.004 * j) for k, t in enumerate(base) for j in range(6)]
    texts += ["", " \t\n", None, "one", "One  two", "one two", base[0], base[0].upper(), "Äé " * 50]
    rows = list(enumerate(texts, 5)) + [(5, base[0]), (None, base[1]), (None, "alone here by itself now"), (-3, base[2])]
    expected = plain_components(rows)
    got = simhash(docs(rows)).collect()
    assert len(got) == len(rows)
    by_row = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got)
    assert by_row == sorted(
        (str(i), f"{plain_fingerprint(t):016x}", str(expected[plain_fingerprint(t)])) for i, t in rows
    )
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got})


def test_long_text_is_read_whole():
    text = prose(1, 70_000)
    assert fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


def test_fingerprints_at_every_distance(spark):
    """Links by index equal links by comparing all, on fingerprints that lie close together."""
    from tripflow.llm.simhash import links

    draw = np.random.default_rng(3)
    centres = draw.integers(-(2**63), 2**63, 8)
    prints = set()
    for c in centres.tolist():
        for _ in range(60):
            flips = draw.choice(64, draw.integers(0, 6), replace=False)
            prints.add(c ^ int(np.bitwise_xor.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64)), initial=np.uint64(0)).view(np.int64)))
    prints = sorted(prints)
    table = spark.createDataFrame([(p, p) for p in prints], "fp long, part long")
    got = sorted((r.a, r.b) for r in links(table).collect())
    assert got == [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 4]


def test_empty_table(docs):
    empty = docs([])
    assert simhash(empty).collect() == []
    assert one_of_each(empty).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(docs):
    base = [prose(k, 400) for k in range(12)]
    near = [edited(t, k, 0.004) for k, t in enumerate(base)]
    rows = list(enumerate(base)) + [(20 + k, t) for k, t in enumerate(base)] + [(40 + k, t) for k, t in enumerate(near)]
    assert any(0 < (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() <= 4 for a, b in zip(base, near, strict=True))
    rows += [(3, base[3]), (None, base[4]), (90, ""), (91, None)]
    table = docs(rows).withColumn("component_id", F.lit("kept")).withColumn("fp", F.lit(1))
    kept = one_of_each(table)
    assert kept.columns == table.columns
    found = sorted(str(r.doc_id) for r in kept.collect())
    assert found == sorted([str(k) for k in {*plain_components(rows).values()}] + ["None"])
    assert len(found) < 30
