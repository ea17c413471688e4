"""What the operators of this package share: tables, saved intermediate results, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ternion.plans.checkpoints import saved, shared_dir

#: Fixed value: the characters that separate words, and the class of the others.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows for each file of a saved table of a few numbers a row.
FILE_ROWS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_files(df: DataFrame) -> int:
    """How many files hold saved tables of about as many short rows as df has: one for each core at least.

    Shuffles may have many more partitions than that, whatever little is in them.  A file each costs
    more than its rows: Hadoop's local files alone fork a process of the executor for each file made.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // FILE_ROWS))


def n_words(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has; null: 0.  Each word becomes one sign; no array of words is made."""
    signs = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WORD_CLASS}+{SPACE_CLASS}*", "x")
    return F.length(F.btrim(signs, F.lit(SPACE_CHARS))).cast("long")


def numbered(df: DataFrame, keys: list[str], name: str, group: str | None = None, weight: str | None = None, nulls_last: bool = False) -> DataFrame:
    """Rows of df with their place in the order of ``keys``, found without one task seeing all rows.

    The rows are dealt out by ranges of the keys and sorted there; a row's place is its place in
    its range plus the sum over earlier ranges.  With ``group`` (the first of the keys) places are
    counted in each group; with ``weight`` the places are sums of that column over the rows before.
    Groups that fill many ranges are so spread over many tasks.  The result is saved.

    Rows that agree in all keys may change places among each other; keys should tell rows apart.
    """
    order = [F.col(k).asc_nulls_last() if nulls_last else F.col(k).asc_nulls_first() for k in keys]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = saved(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    at = at.withColumn("_range", F.shiftright("_at", 33))
    step = F.col(weight) if weight else F.lit(1).cast("long")
    by = ["_range", group] if group else ["_range"]
    inner = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = at.groupBy(*by).agg(F.sum(step).alias("_sum"))
    # a row for each range and group: as few as there are ranges, besides groups that lie in one range
    if group:
        alone = ranges.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
        many = alone.filter("_n > 1").select("_g")
        split = ranges.join(many, F.col(group).eqNullSafe(F.col("_g")), "left_semi")
        outer = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    else:
        split = ranges
        outer = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = split.withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).select(F.col("_range").alias("_r"), *([F.col(group).alias("_k")] if group else []), "_base")
    meet = (F.col("_range") == F.col("_r")) & (F.col(group).eqNullSafe(F.col("_k")) if group else F.lit(True))
    local = at.withColumn("_before", F.coalesce(F.sum(step).over(inner), F.lit(0)))
    full = local.join(base, meet, "left").withColumn("position", F.col("_before") + F.coalesce("_base", F.lit(0)))
    return full.select(*df.columns, "position")


__all__ = ["few_files", "numbered", "n_words", "saved", "shared_dir", "table"]
