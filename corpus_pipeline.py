"""Training corpus from ``documents``: classify, drop near copies, decontaminate, mix, shard.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridledger.llm import common, decontaminate, mixing, quality, sharding, shingles


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is trained on those labelled good and not toxic."""
    return quality.train(docs, common.read(spark, sf_dir, "labels")).keep(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash candidates (covering tables and blocks of several fingerprints)
    with a verified Jaccard similarity of five-word shingles of 0.8 or more."""
    return shingles.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no large share of benchmark passages."""
    return decontaminate.keep_clean(docs, common.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it."""
    return sharding.assigned(docs)


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mix),
    ("sharding", shard),
]

#: The classifier's and the shuffle's results cannot be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = common.read(spark, sf_dir, "documents")
    folder = common.shared_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
