"""One registered query for each operator, over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripflow.llm.common import table
from tripflow.llm.decontam import contaminated
from tripflow.llm.graph import near_vectors
from tripflow.llm.mixing import mix
from tripflow.llm.oracles import ORACLE_SQL
from tripflow.llm.pii import SAMPLE_KEY, pii, pii_key
from tripflow.llm.quality import quality
from tripflow.llm.ranked import ranked
from tripflow.llm.simhash import simhash
from tripflow.llm.substrings import substrings
from tripflow.llm.topk import nearest
from tripflow.llm.toxicity import toxicity
from tripflow.llm.urls import url_verdicts
from tripflow.llm.variants import variants
from tripflow.llm.warc import revisits


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"), pii_key(spark, SAMPLE_KEY))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits(table(spark, sf_dir, "pages"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_reputation": op2_url_reputation,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_topk": op5_topk,
    "op6_substrings": op6_substrings,
    "op7_mix": op7_mix,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_revisits": op10_revisits,
    "op11_ranked": op11_ranked,
    "op12_near_vectors": op12_near_vectors,
    "op13_variants": op13_variants,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
