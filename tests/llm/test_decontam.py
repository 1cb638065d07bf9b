import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from llm.texts import prose

from tripflow.llm import decontam
from tripflow.llm.decontam import ItemIndex, allowed_edits, contaminated, drop_contaminated, edits, words_of


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_hits(text, items):
    """item -> (edits, start) of the best window, by comparing every window with every item."""
    words, found = words_of((text or "").encode()), {}
    for i, t in items:
        item = words_of((t or "").encode())
        n = len(item)
        if n < decontam.MIN_ITEM_WORDS:
            continue
        for s in range(len(words)):
            if len(words) - s < n - allowed_edits(n):
                break
            window = words[s : s + n]
            distance = plain_edits(window + [None] * (n - len(window)), item)
            if distance <= allowed_edits(n):
                found[i] = min(found.get(i, (distance, s)), (distance, s))
    return found


def changed(words, n, draw):
    words = list(words)
    for _ in range(n):
        at = draw.randrange(len(words))
        kind = draw.randrange(3)
        if kind == 0:
            words[at] = "zz" + words[at]
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "new")
    return words


def items_and_texts():
    draw = random.Random(5)
    items = [(k, prose(5_000 + k, 10 + 3 * k)) for k in range(14)]
    texts = []
    for i, t in items:
        for n in range(0, 4):
            body = changed(t.split(), n, draw)
            texts.append(" ".join([prose(i + 70 * n, 30), *body, prose(i + 900 * n, 25)]))
        texts.append(" ".join(t.split()[: -allowed_edits(len(t.split())) or None]))
    return items, texts + [prose(k, 200) for k in range(40)]


def test_against_all_windows(docs, spark):
    items, texts = items_and_texts()
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "a"), (0, texts[0]), (None, texts[5])]
    bench = items + [(50, None), (51, ""), (52, "too few words"), (3, items[3][1])]
    table = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = contaminated(docs(rows), table).collect()
    expected = [(i, item, s, d) for i, t in rows for item, (d, s) in plain_hits(t, items).items()]
    assert len(expected) > 50
    wanted = {x[:2] for x in expected}
    assert {(r.doc_id, r.item_id) for r in got} <= wanted
    assert len({(r.doc_id, r.item_id) for r in got}) >= 0.99 * len(wanted)
    # What was found is the best window.
    best = {x[:2]: x[2:] for x in expected}
    same = [(r.start_word, r.edits) == best[r.doc_id, r.item_id] for r in got]
    assert np.mean(same) >= 0.97
    assert [r for r in got if r.doc_id == 0 and r.item_id == 0 and r.edits == 0]


def test_clean_documents_stay(docs, spark):
    items, texts = items_and_texts()
    table = docs(list(enumerate(texts))).withColumn("item_id", F.lit("x"))
    kept = drop_contaminated(table, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == table.columns
    clean = {i for i, t in enumerate(texts) if not plain_hits(t, items)}
    found = {r.doc_id for r in kept.collect()}
    assert clean <= found
    assert len(found - clean) <= 0.02 * len(texts)


def test_blocks_of_items(docs, spark, monkeypatch):
    items, texts = items_and_texts()
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(contaminated(docs(texts[:30]), table).collect(), key=str)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    assert sorted(contaminated(docs(texts[:30]), table).collect(), key=str) == whole


def test_pieces(docs, spark, monkeypatch):
    items, texts = items_and_texts()
    index = ItemIndex([(i, t.encode()) for i, t in items])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    whole = [x for b in decontam._scan(index, iter([batch])) for x in b.to_pylist()]
    monkeypatch.setattr(decontam, "PIECE_WORDS", 50)
    assert [x for b in decontam._scan(index, iter([batch])) for x in b.to_pylist()] == whole


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs(["a b c"]), none).collect() == []
    assert drop_contaminated(docs(["a b c"]), none).count() == 1
    one = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert contaminated(docs([]), one).collect() == []


def test_edit_distances():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 4, (60, 12)), draw.integers(0, 4, (60, 12))
    assert edits(a, b).tolist() == [plain_edits(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_edit_distances_in_a_band():
    draw = np.random.default_rng(2)
    for n in (1, 2, 7, 12):
        a, b = draw.integers(0, 3, (80, n)), draw.integers(0, 3, (80, n))
        # Shifted rows, whose best path leaves the diagonal.
        b[:40] = np.roll(a[:40], draw.integers(0, 3), axis=1)
        true = np.array([plain_edits(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        for most in range(n + 1):
            got = edits(a, b, most)
            assert (np.where(true <= most, got == true, got > most)).all()


def test_least_edits_is_a_lower_bound():
    items, _ = items_and_texts()
    index = ItemIndex([(i, t.encode()) for i, t in items])
    draw = np.random.default_rng(3)
    for n, members in index.by_size.items():
        members = np.repeat(members, 20)
        windows = np.stack([draw.permutation(index.codes[m]) for m in members])
        windows[draw.random(windows.shape) < 0.2] = 0
        bound = index._least_edits(windows, members)
        true = edits(windows, np.stack([index.codes[m] for m in members]))
        assert (bound <= true).all()
        for w, m, k in zip(windows.tolist(), members, bound.tolist(), strict=True):
            mine, theirs = Counter(w), Counter(index.codes[m].tolist())
            assert k == n - (mine & theirs).total()


def test_very_long_items_and_documents(docs, spark):
    """Long items, whose shifted windows are hits by the hundred, whole and edited, in long documents."""
    draw = random.Random(9)
    items = [(1, prose(1, 1_500)), (2, prose(2, 900))]
    edited = " ".join(changed(items[0][1].split(), 60, draw))
    rows = [(1, f"{prose(3, 3_000)} {items[0][1]} {prose(4, 3_000)} {items[1][1]}"), (2, edited), (3, prose(6, 20_000))]
    rows += [(4, f"{items[1][1]} {items[1][1]}"), (5, " ".join(items[1][1].split()[:-100]))]
    got = contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): (r.start_word, r.edits) for r in got}
    assert len(got) == len(found) == 5
    words = [words_of(t.encode()) for _, t in items]
    assert found[1, 1] == (3_000, 0) and found[1, 2] == (6_000 + len(words[0]), 0)
    assert found[4, 2] == (0, 0) and found[5, 2] == (0, 100)
    assert found[2, 1][1] <= 75
