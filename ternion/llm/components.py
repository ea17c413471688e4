"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternion.llm.common import saved

#: The rounds grow with the logarithm of the longest path; this many are never reached.
MOST_ROUNDS = 60


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node reachable.

    Alternates the large-star and small-star steps (Kiveris and others, SoCC 2014): every node's
    neighbours are tied to the least of them, until each component is one star around its least
    node.  A hub costs a pre-aggregated minimum and a join whose skewed side is split, never a list
    of its neighbours.  Each round is saved to the shared folder, so lost executors cost one round,
    in as many ``files`` at most; unset, in one for each partition.

    Nodes are 64-bit integers.  No edges: no rows.  Loops (a = b) and repeated edges are allowed;
    edges with a null end are left out.
    """
    tied = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null").distinct()
    loops = tied.filter("a = b")
    packed = lambda df: df if files is None else df.coalesce(files)
    now, before = saved(packed(tied.filter("a <> b")), "edges"), None
    for _ in range(MOST_ROUNDS):
        # large star: neighbours above a node go to the least node around it
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_low")).select(F.col("a").alias("_n"), F.least("a", "_low").alias("_m"))
        large = both.join(low, F.col("a") == F.col("_n")).filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its lower neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_n")
        small = large.join(low, F.col("a") == F.col("_n")).select(F.col("b").alias("a"), F.col("_m").alias("b")).union(low.select("_n", "_m")).filter("a <> b").distinct()
        now = saved(packed(small), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b")).union(loops.select("a", "b").join(now, loops["a"] == now["a"], "left_anti")).distinct()
