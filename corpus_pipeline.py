"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the result is written as Parquet and read
again before the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantara.llm import decontaminate, language, minhash, mixing, sharding
from quantara.llm._common import scratch_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no language for 0.4 of their n-grams, go."""
    return language.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them: not at all, once, or as two rows."""
    return mixing.take_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with size, shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shard),
]

#: Models and signatures are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the table of documents."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
