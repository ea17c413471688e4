"""A corpus pipeline over the documents table: each stage is one operator of ternion.llm.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads what
the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ternion.llm import decontaminate, jaccard, mixing, quality, sharding
from ternion.llm.common import saved, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash index over five-word shingles with min-hash bands beside it, whole sets of a similarity of 0.8 or more."""
    return jaccard.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some sources repeated, some cut short."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: its shard and place in it."""
    return sharding.shard(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("mixing", mix), ("sharding", shard)]

#: SQL has no min-hash, logistic regression or XXH64; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
