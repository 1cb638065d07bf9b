import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm.texts import prose

from tripflow.llm import substrings as module
from tripflow.llm.substrings import remove_repeated, substrings


def plain(rows, window=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    found = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        found.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(found)


def rows_with_passages():
    draw = random.Random(9)
    passages = [prose(7_000 + k, n) for k, n in enumerate((34, 35, 36, 50, 80, 200))]
    rows = []
    for k in range(60):
        parts = [prose(k, draw.randrange(1, 120))]
        for _ in range(draw.randrange(3)):
            parts += [draw.choice(passages), prose(500 + k, draw.randrange(0, 60))]
        rows.append((k, " \n\t".join(parts)))
    rows += [(100 + k, rows[k][1]) for k in range(8)]
    rows += [(200, "same " * 100), (201, "a b " * 30), (202, None), (203, ""), (204, " "), (205, prose(3, 34))]
    # A passage twice in one document, cut anew elsewhere, and copies with another case or other white space.
    rows += [(206, f"{passages[3]} x {passages[3]}"), (207, passages[4].upper()), (208, passages[4].replace(" ", "\x0b"))]
    return rows + [(5, rows[5][1]), (None, rows[6][1]), (None, passages[5]), (209, "é " + passages[5])]


def test_against_all_windows(docs):
    rows = rows_with_passages()
    table = docs(rows).withColumns({"doc": F.lit(1), "seed": F.lit("x"), "at": F.lit(2)})
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings(table).collect())
    assert got == plain(rows)


@pytest.mark.parametrize("window, seed", [(5, 2), (8, 8), (13, 4)])
def test_other_windows(docs, window, seed):
    rows = list(enumerate(prose(k % 7, 30 + k, vocabulary=30) for k in range(40)))
    got = remove_repeated(docs(rows), window=window, seed=seed).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == plain(rows, window)


def test_factors_rebuild_the_text(docs):
    """Each factor's words are those of its source; factors do not overlap, and with the literals they make the text."""
    rows = [(i, t) for i, t in rows_with_passages() if i is not None]
    words = {i: (t or "").encode().split() for i, t in rows}
    found = module.factors(docs(rows)).collect()
    parsed = {}
    for r in found:
        assert (r.doc_id, r.start) != (r.source_id, r.source_start) or r.doc_id == 5  # a repeated row
        assert words[r.doc_id][r.start : r.start + r.n] == words[r.source_id][r.source_start : r.source_start + r.n]
        parsed.setdefault(r.doc_id, set()).add((r.start, r.n))
    for i, spans in parsed.items():
        rebuilt, at = [], 0
        for start, n in sorted(spans):
            assert start >= at
            rebuilt += words[i][at:start]
            rebuilt += next(
                words[r.source_id][r.source_start : r.source_start + n] for r in found if (r.doc_id, r.start) == (i, start)
            )
            at = start + n
        assert rebuilt + words[i][at:] == words[i]
    assert max(r.n for r in found) >= 200 and {100, 101} <= {r.doc_id for r in found} | {r.source_id for r in found}


def test_greedy_parse():
    m = lambda start, end: module.Match(start, end, b"s", start + 100)
    outer = module.outermost([m(0, 20), m(2, 18), m(5, 40), m(30, 45), m(44, 50), m(60, 90)])
    assert outer == [m(0, 20), m(5, 40), m(30, 45), m(44, 50), m(60, 90)]
    parsed = [(f.start, f.end, f.source_start) for f in module.parse(100, outer, 5)]
    assert parsed == [(0, 20, 100), (20, 40, 120), (40, 45, 140), (45, 50, 145), (60, 90, 160)]
    # Too short ones are literals, but the next match may reach back over them.
    assert [(f.start, f.end) for f in module.parse(100, outer, 6)] == [(0, 20), (20, 40), (44, 50), (60, 90)]


def test_random_windows(docs):
    """Few different words, so that windows are equal at many places, in many ways."""
    for seed in range(3):
        draw = random.Random(seed)
        pool = [prose(k, 25, vocabulary=12) for k in range(6)]
        rows = [(i, " ".join(draw.choice(pool) for _ in range(draw.randint(1, 9)))) for i in range(40)]
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings(docs(rows)).collect())
        assert got == plain(rows)


def test_long_documents(docs):
    """Passages across the ends of reference blocks."""
    text = prose(1, 3_000).split()
    rows = [(0, " ".join(text))] + [(k, " ".join([prose(k, 10), *text[90 * k : 90 * k + 400]])) for k in range(1, 25)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings(docs(rows)).collect())
    assert got == plain(rows)


def test_frequent_passage(docs):
    passage = prose(1, 60)
    rows = [(k, f"{prose(k + 10, 20)} {passage} {prose(k + 900, 9)}") for k in range(300)]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings(docs(rows)).collect()) == plain(rows)


def test_empty_table(docs):
    assert substrings(docs([])).collect() == []


def test_every_window_holds_a_seed():
    hashes = np.random.default_rng(2).integers(0, 50, 3_000).astype(np.uint64)
    at, _ = module.seeds(hashes)
    for start in range(len(hashes) - 35 + 1):
        assert ((at >= start) & (at <= start + 35 - 12)).any()
    assert len(at) < 0.2 * len(hashes)


def test_runs_tell_windows_apart():
    hashes = np.random.default_rng(3).integers(0, 3, 400).astype(np.uint64)
    for size in (1, 2, 5, 12, 35):
        runs = module.runs(hashes, size, module._ODD[0]).tolist()
        windows = [tuple(hashes[i : i + size].tolist()) for i in range(len(hashes) - size + 1)]
        assert len(runs) == len(windows)
        assert len(set(zip(runs, windows, strict=True))) == len(set(windows)) == len(set(runs))
