import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from llm.texts import prose

from tripflow.llm.queries import QUERIES
from tripflow.llm.simhash import fingerprint

INSULTS = "vilegrub dolthead scumlet wretchling".split()
CARD = "4111111111111111"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A corpus with toxic texts, exact and near copies, benchmark passages and card numbers; what should go."""
    draw = random.Random(8)
    rows, labels, gone, copies = [], [], {"toxic": set(), "contaminated": set()}, []
    items = [(k, prose(8_000 + k, 30 + k)) for k in range(10)]
    for k in range(420):
        text = prose(k, draw.randrange(120, 200))
        if k % 6 == 0:
            words = text.split()
            for _ in range(5):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
            text = " ".join(words)
            gone["toxic"].add(k)
        elif k % 20 == 1:
            text = f"{text} {items[k % 10][1]} {prose(k + 600, 20)}"
            gone["contaminated"].add(k)
        elif k % 20 == 2:
            text = f"{text} {CARD} end"
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
        labels.append((k, 1, int(k in gone["toxic"])))
    for k in range(5, 400, 20):
        if k not in gone["toxic"]:
            copies.append(k)
            near = rows[k][1].split()
            near[len(near) // 2] = "swapped"
            rows.append((1_000 + k, rows[k][1], "en", "src0", 1))
            rows.append((2_000 + k, " ".join(near), "en", "src1", 1))
    rows += [(5_000, None, None, None, None), (5_001, "", "en", "", 0), (None, "text without an id", "de", "src2", 3)]
    rows.append((5_002, prose(77, 20_000), "en", "src2", 9))
    folder = tmp_path_factory.mktemp("planted")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, gone, copies


def test_stages(spark, planted):
    folder, rows, gone, copies = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        if name != "mixing":
            assert docs.columns == names
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    everything = {r[0] for r in rows}
    assert len(gone["toxic"] & kept["toxicity"]) <= 0.1 * len(gone["toxic"])
    assert len((everything - gone["toxic"]) - kept["toxicity"]) <= 0.02 * len(everything)
    for k in copies:
        assert not {1_000 + k} & kept["near_duplicates"] and k in kept["near_duplicates"]
    text = {r[0]: (r[1] or "").encode() for r in rows}
    near = {k for k in copies if ((fingerprint(text[k]) ^ fingerprint(text[2_000 + k])) % 2**64).bit_count() <= 4}
    assert near and all((2_000 + k in kept["near_duplicates"]) == (k not in near) for k in copies)
    lost = kept["toxicity"] - kept["near_duplicates"]
    assert lost <= {x + k for x in (1_000, 2_000) for k in copies} | {5_001}
    assert kept["near_duplicates"] - kept["decontamination"] == gone["contaminated"] & kept["near_duplicates"]
    assert kept["personal_data"] == kept["decontamination"] == kept["mixing"]
    final = {r.doc_id: r for r in docs.collect()}
    assert not any(CARD in (r.text or "") for r in final.values())
    assert len({r.text.split()[-2] for k, r in final.items() if k is not None and k % 20 == 2 and k < 420}) == 1
    assert all(r.mix_slot is not None for r in final.values())


def test_run(spark, planted):
    folder, rows, _, _ = planted
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "mix_block", "mix_slot", "mix_row", "in_mix"} <= set(found.columns)
    assert 0 < found.count() < len(rows)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, planted):
    folder, _, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    extra = {n: F.lit(n) for n in ("score", "fp", "node", "component_id", "item_id", "label", "doc", "_s", "s", "row", "kept_id", "k")}
    docs = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert set(extra) <= set(docs.columns), name
    row = docs.first()
    assert all(row[n] == n for n in extra)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
