"""A corpus pipeline of five operators: each stage takes what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.llm.decontaminate import drop_contaminated
from bazaarlens.llm.exact_dedup import drop_copies
from bazaarlens.llm.mixing import mixed_documents
from bazaarlens.llm.quality import drop_poor
from bazaarlens.llm.shared import shared_folder
from bazaarlens.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_poor(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(spark, docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

# Fitted weights, XXH64 fingerprints and hashed ranks: not for SQL. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are a stored table before the next reads them."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        kept.write.mode("overwrite").parquet(f"{folder}/stage{number}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/stage{number}")
    return docs
