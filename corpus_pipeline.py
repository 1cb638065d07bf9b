"""The corpus pipeline: toxicity, near-duplicates, benchmark contamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of `documents`; the last adds the place of each document in the mix. Nulls, empty and very long texts, ties,
repeated rows, empty tables and further columns are handled as the operators' own notes say; rows without an id are
never taken for copies and so pass the second stage.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripflow.llm.common import table, written
from tripflow.llm.decontam import drop_contaminated
from tripflow.llm.mixing import mixed
from tripflow.llm.pii import SAMPLE_KEY, pii_key, pseudonymise
from tripflow.llm.simhash import one_of_each
from tripflow.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates and addresses in the texts become pseudonyms; every document stays.

    The key is that of the session or the environment; the sample key stands in where these invented tables have none.
    """
    return pseudonymise(docs, pii_key(spark, SAMPLE_KEY))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its block, slot and row in the mix of the sources."""
    return mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

# Compression lengths, fingerprints and walks have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
