"""Training-data pipeline over the documents table: each stage works on what the one before kept.

Quality rules drop what they reject, near-dedup keeps one document of each group, decontamination
drops documents that hold benchmark passages, the secret scan masks secrets, and mixing draws the
documents for the target weights, with its columns mix_epoch, mix_block, mix_start, mix_weight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapmart.llm import decontamination, mixing, near_dedup, quality_rules, secret_scan
from snapmart.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_by_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs, secret_scan.train(secret_scan.samples(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scan", secrets),
    ("temperature mixing", mix),
]

#: no SQL: MinHash groups are components, and the secret stage applies a trained model
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after the last stage; every stage's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
