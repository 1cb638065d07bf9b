import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm.texts import prose

from tripflow.llm.common import labelled_sample
from tripflow.llm.quality import quality
from tripflow.llm.toxicity import drop_toxic, toxicity

INSULTS = "vilegrub dolthead scumlet wretchling".split()


def with_words(text, words, draw, n):
    parts = text.split(" ")
    for _ in range(n):
        parts.insert(draw.randrange(len(parts)), draw.choice(words))
    return " ".join(parts)


def toxic_corpus(n=600):
    draw = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        text = prose(k, draw.randrange(40, 160))
        toxic = k % 4 == 0
        rows.append((k, with_words(text, INSULTS, draw, draw.randrange(3, 7)) if toxic else text))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def quality_corpus(n=400):
    draw = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        text = prose(k, draw.randrange(40, 160))
        good = k % 2
        rows.append((k, text if good else " ".join(w + draw.choice(["$$$", "%%%", " | "]) for w in text.split(" "))))
        labels.append((k, good, 0))
    return rows, labels


@pytest.mark.parametrize("operator, corpus, folds, fold", [(toxicity, toxic_corpus, 3, 1), (quality, quality_corpus, 4, 2)])
def test_held_out(docs, labels, operator, corpus, folds, fold):
    rows, known = corpus()
    edge = [(5_000, None), (5_001, ""), (5_002, " \n"), (None, rows[0][1]), (0, rows[0][1]), (5_003, prose(1, 30_000))]
    table = docs(rows + edge).withColumns({"score": F.lit("x"), "label": F.lit(2), "held_out": F.lit(None).cast("int")})
    more = [(None, 1, 1), (7, None, None), (8, 5, 5), (9_999, 1, 1), known[0]]
    got = operator(table, labels(known + more))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert [t for _, t in got.dtypes[:4]] == ["bigint", "boolean", "double", "int"]
    found = got.collect()
    assert len(found) == len(rows) + len(edge)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold)
    truth = {i: toxic if operator is toxicity else good for i, good, toxic in known}
    out = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(out) > 50
    assert sum(p == t for p, t in out) >= 0.95 * len(out)
    # The same text scores alike whatever its id, and empty texts alike.
    assert len({r.score for r in found if r.doc_id in (0, None)}) == 1
    assert len({r.score for r in found if r.doc_id in (5_000, 5_001, 5_002)}) == 1


def test_toxic_rows_go(docs, labels):
    rows, known = toxic_corpus()
    table = docs(rows + [(9_000, None), (9_001, "")]).withColumn("score", F.lit(9))
    kept = drop_toxic(table, labels(known))
    assert kept.columns == table.columns
    found = {r.doc_id for r in kept.collect()}
    toxic = {i for i, _, t in known if t}
    assert {9_000, 9_001} <= found
    assert len(found & toxic) <= 0.05 * len(toxic)
    assert len(found - toxic) >= 0.99 * (len(rows) - len(toxic))


@pytest.mark.parametrize("operator", [toxicity, quality])
@pytest.mark.parametrize("known", [[], [(k, 1, 1) for k in range(9)]])
def test_too_few_labels(docs, labels, operator, known):
    got = operator(docs([prose(k, 30) for k in range(12)]), labels(known)).collect()
    assert len({r.score for r in got}) == 1


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_empty_tables(docs, labels, operator):
    assert operator(docs([]), labels([(1, 1, 1)])).collect() == []


def test_quality_calibrates_on_all_chunks(docs, labels):
    from tripflow.llm import quality as module

    # Long texts whose style changes at one chunk.
    rows = [(k, prose(k, 4_000) + (" zxq" * 400 if k % 2 else "") + prose(k + 500, 1_500)) for k in range(60)]
    sampled = [(k, p[:: -(-len(p) // 8)], k % 2) for k, t in rows if len(p := module.chunks(t.encode())) > 8]
    assert len(sampled) == 60
    models = module.fold_models(sampled)
    data = np.array([(*models[module.fold_of(k)].features(module.chunks(t.encode())), k % 2) for k, t in rows])
    model = module.train(docs(rows), labels([(k, k % 2, 0) for k, _ in rows]))
    assert np.allclose(model.weights, module.fit_logistic(data[:, :2], data[:, 2], ridge=1e-3))


def test_sample_of_an_id_with_several_texts(spark, labels):
    rows = [(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (3, None), (None, "x"), (4, "unlabelled")]
    known = labels([(1, 0, 0), (1, 1, 0), (2, 0, 0), (3, 0, 1), (None, 1, 1), (9, 1, 1)])
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = labelled_sample(table, known, "quality", F.lit(True), (5, 5)).collect()
        assert sorted((r.doc_id, r.text or "", r.label) for r in got) == [(1, "a", 1), (2, "c", 0), (3, "", 0)]
