"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests.
OWN_SHARED_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, else our own."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or OWN_SHARED_DIR


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns what was written.

    This cuts the lineage, is computed once however often it is read, and outlives executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ternion-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
