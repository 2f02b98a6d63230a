"""From raw documents to packed training sequences; part of the optional operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollscale.llm import classifier, exact, neardup, packing, personal
from rollscale.llm.common import documents, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.accept(docs, weights)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles at 0.8 or more."""
    return neardup.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return personal.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids."""
    import public_tokenizers as vocabularies

    return packing.pack(docs, vocabularies.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Trained models and tokenizers are beyond SQL; tests/llm compares stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
