"""Statistics of a graph: counts, predicate and numeric histograms, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.sources.store import TripleStore

BUCKETS = 100


def counts(store: TripleStore, approximate: bool = False) -> dict[str, int]:
    """Triples, distinct subjects, predicates and objects."""
    distinct = (lambda *c: F.approx_count_distinct(F.struct(*c))) if approximate else (lambda *c: F.count_distinct(F.struct(*c)))
    r = store.df.agg(F.count("*").alias("triples"), distinct("sk", "s").alias("subjects"), F.count_distinct("p").alias("predicates"), distinct("k", "v", "dt", "lang").alias("objects")).first()
    return r.asDict()


def predicate_histogram(store: TripleStore) -> DataFrame:
    return store.df.groupBy("p").agg(F.count("*").alias("count"))


def numeric_histogram(store: TripleStore, predicate: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, low, high, count): equal widths over the numeric objects of a predicate."""
    numbers = store.df.filter((F.col("p") == predicate) & F.col("dt").isin(*t.NUMERIC)).select(F.col("v").try_cast("double").alias("x")).filter("x is not null")
    low, high = numbers.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return numbers.select(F.lit(0).alias("bucket"), F.col("x").alias("low"), F.col("x").alias("high"), F.lit(0).cast("long").alias("count"))
    width = (high - low) / buckets or 1.0
    bucket = F.least(F.floor((F.col("x") - low) / width), F.lit(buckets - 1)).cast("int")
    return numbers.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count")).select("bucket", (F.lit(low) + F.col("bucket") * width).alias("low"), (F.lit(low) + (F.col("bucket") + 1) * width).alias("high"), "count")


def range_selectivity(store: TripleStore, predicate: str, low: float | None = None, high: float | None = None) -> float:
    """The estimated share of a predicate's numbers within a range, from its histogram."""
    rows = numeric_histogram(store, predicate).collect()
    total = sum(r["count"] for r in rows)
    if not total:
        return 0.0
    part = 0.0
    for r in rows:
        a, b = max(r.low, low if low is not None else r.low), min(r.high, high if high is not None else r.high)
        part += r["count"] * max(0.0, b - a) / (r.high - r.low) if b > a else 0.0
    return min(1.0, part / total)


def range_scan(store: TripleStore, predicate: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(s, x): subjects with a number of a predicate within a range, both bounds included, either open."""
    x = F.col("v").try_cast("double")
    rows = store.df.filter((F.col("p") == predicate) & F.col("dt").isin(*t.NUMERIC)).select("s", x.alias("x"))
    if low is not None:
        rows = rows.filter(F.col("x") >= low)
    return rows.filter("x is not null") if high is None else rows.filter(F.col("x") <= high)
