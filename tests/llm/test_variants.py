import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.texts import prose
from tripflow.llm import variants as module
from tripflow.llm.variants import near_words, one_edit, variants


def edits(word, alphabet):
    """All strings one edit away."""
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in alphabet)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in alphabet if c != word[i])


def close(words):
    alphabet = sorted(set("".join(words)))
    known = set(words)
    return {(w, e) for w in known for e in edits(w, alphabet) if e in known and e != w}


def plain(rows):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = None if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {}
    for a, b in close(words) if words else ():
        near.setdefault(a, []).append(b)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x))
        if words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near.get(w, [])), words[form[w]] if w in form else None))
    return sorted(out)


def got(table):
    return sorted(map(tuple, variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=6), min_size=1, max_size=80, unique=True))
def test_recurrence(words):
    expected = {(a, b) for a, b in close(words) if len(a) <= len(b)}
    found = set()
    for m in {len(w) for w in words}:
        queries = [w for w in words if len(w) == m]
        found |= {(queries[q], words[w]) for q, w in zip(*one_edit(queries, words), strict=True)}
    assert found == expected


@pytest.mark.parametrize("block,bin_words", [(2_048, 512), (8, 5)])
def test_each_pair_once(spark, monkeypatch, block, bin_words):
    monkeypatch.setattr(module, "BLOCK_WORDS", block)
    monkeypatch.setattr(module, "BIN_WORDS", bin_words)
    draw = random.Random(3)
    words = {"".join(draw.choices("ab", k=draw.randint(7, 10))) for _ in range(300)} | {"a" * k for k in range(7, 12)}
    words |= {"x" * 300, "x" * 301, "x" * 299 + "y"}
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    found = [(r.word, r.near) for r in near_words(table).collect()]
    assert len(found) == len(set(found)) and set(found) == close(words)


def test_chains_and_rows(spark, docs):
    draw = random.Random(1)
    rows = [(i, prose(i, 300, 900)) for i in range(60)]
    rows += [(1000 + i, "abcdefghij " * 30) for i in range(40)]  # often
    rows += [(2000, "abcdefghik " * 60), (2001, "abcdefgik abcdefgik Abcdefgik abcdefgik abcdefgik")]  # a chain of forms
    rows += [(2002, "Élevage ÉLEVAGE élevages ×levage"), (2003, None), (2004, ""), (None, "abcdefghijk " * 3), (5, rows[5][1])]
    rows += [(2005, "w" * 300 + " " + "w" * 300), (2006, "".join(draw.choices("abc", k=5000)) + " x")]
    table = docs(rows).withColumns({"n": F.lit(1), "word": F.lit("x"), "h": F.lit(2)})
    assert got(table) == plain(rows)
    assert any(r[2] not in (r[0], r[1]) for r in got(table))


def test_very_long_word(spark):
    table = spark.createDataFrame([("y" * 20_000, 2), ("y" * 19_999, 30), ("z" * 20_000, 2)], "word string, n long")
    found = sorted((len(r.word), len(r.near), r.near_n) for r in near_words(table).collect())
    assert found == [(19_999, 20_000, 2), (20_000, 19_999, 30)]


def test_empty(docs):
    assert got(docs([])) == [] == got(docs([None, "", "short words only"]))
