import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import prose
from tripflow.llm import ranked as module
from tripflow.llm.ranked import build_index, ranked, search, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def plain(rows, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in set(items):
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, counts in asked.items():
        scored = []
        for doc_id, c in docs:
            m = 100 - 75 + (75 * c.total() * n_docs) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, q in counts.items()
                if t in c
            )
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block,window,part", [(1 << 13, 1 << 10, 1 / 32), (7, 3, 1 / 3), (40, 8, 0.2), (40, 8, 0), (40, 8, 1)])
def test_against_all(spark, docs, monkeypatch, block, window, part):
    monkeypatch.setattr(module, "BLOCK_DOCS", block)
    monkeypatch.setattr(module, "WINDOW_DOCS", window)
    monkeypatch.setattr(module, "SHORT_PART", part)
    rows = [(i, prose(i % 250, 5 + 7 * (i % 40), 300)) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "... --- !"), (None, prose(1, 200, 300)), (5, rows[5][1]), (403, "Éa éa ÉA ab-CD_e1")]
    rows += [(500 + i, rows[3][1]) for i in range(60)]
    items = [(i, prose(i, 30, 300)) for i in range(25)] + [(30, None), (31, ""), (None, "an"), (32, "Éa ab cd E1 ab"), (33, "nowhere1")]
    items += [items[0], (1, "th an re")]
    table = docs(rows).withColumns({"term": F.lit("x"), "score": F.lit(1)})
    got = sorted(map(tuple, ranked(table, items_table(spark, items)).collect()))
    assert got == plain(rows, items) and got


def test_packs_and_one_index(spark, docs, monkeypatch):
    rows = [(i, prose(i, 80, 200)) for i in range(120)]
    items = [(i, prose(1000 + i, 20, 200)) for i in range(12)]
    index = build_index(docs(rows))
    monkeypatch.setattr(module, "PACK_TERMS", 40)
    assert sorted(map(tuple, search(index, items_table(spark, items), 3).collect())) == plain(rows, items, 3)


def test_long_lists_are_skipped(docs, monkeypatch):
    """Once k documents are known, lists that cannot lift others over them are probed for few documents only."""
    draw = np.random.default_rng(1)
    size = 4096
    m = np.full(size, 100)
    common = module._List(m, 3, 100, np.arange(size).astype("<u2").tobytes(), draw.integers(1, 4, size).astype("<u4").tobytes())
    few = draw.choice(size, 50, replace=False)
    rare = module._List(m, 1, 100, np.sort(few).astype("<u2").tobytes(), np.ones(50, "<u4").tobytes())
    best = module.Best(10)
    read = []
    monkeypatch.setattr(module.np, "flatnonzero", lambda x: read.append(found := x.nonzero()[0]) or found)
    module.search_block([(10, common), (9000, rare)], np.arange(size), np.ones(size, bool), best)
    scores = 10 * common.parts
    scores[np.sort(few)] += 9000 * rare.parts
    expected = sorted((-int(s), i) for i, s in enumerate(scores))[:10]
    assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == expected
    assert sum(map(len, read)) < size


def test_pieces(monkeypatch):
    text = "Ab é1 ab; éé x " * 50
    monkeypatch.setattr(module, "PIECE", 7)
    assert {t.decode(): n for t, n in term_counts(text.encode()).items()} == Counter(terms(text))


def test_empty(spark, docs):
    none = items_table(spark, [])
    some = items_table(spark, [(1, "an")])
    assert ranked(docs([]), some).collect() == [] == ranked(docs([None, "-"]), some).collect()
    assert ranked(docs(["an er"]), none).collect() == [] == ranked(docs(["an er"]), items_table(spark, [(1, None)])).collect()


def test_random_items(spark, docs):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(draw.choices(words, weights=range(1, 31), k=draw.randint(1, 60)))) for i in range(500)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 8)))) for i in range(40)]
    assert sorted(map(tuple, ranked(docs(rows), items_table(spark, items)).collect())) == plain(rows, items)
