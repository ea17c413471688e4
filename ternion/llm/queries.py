"""The queries of this package's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternion.llm import decontaminate, digest, licenses, mixing, pii, quality, sharding, simhash, substring, urls
from ternion.llm.common import few_files, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their evidence and posteriors."""
    found = ["evidence", "host_posterior", "path_posterior", "posterior"]
    return quality.kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=found).select("doc_id", *found)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs).select("id", "fp", "component_id").repartition(few_files(docs))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op4_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edit_probe(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence statement of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.withColumn("sentences", F.array_join("sentences", ","))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *(count(k) for k in pii.KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text(F.concat("base", "terms")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_simhash": op2_simhash,
        "op3_decontaminate": op3_decontaminate,
        "op4_digest": op4_digest,
        "op5_substring": op5_substring,
        "op6_licenses": op6_licenses,
        "op7_urls": op7_urls,
        "op8_mixing": op8_mixing,
        "op9_pii": op9_pii,
        "op10_sharding": op10_sharding,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_urls": urls.SQL, "op8_mixing": mixing.SQL}
