"""Registered queries against DuckDB on the smallest tables; all of them run with the driver's check."""

import glob
import math
import os

import pytest

import __spark_entry__
from ternion import queries

TINY = "/root/testdata/sf0.001"
SOME = "bgp_star bgp_everything bgp_triangle optional_outer_filter optional_then_join union_different_variables minus not_exists exists_in_or exists_in_union exists_nested_group exists_optional optional_exists optional_chain minus_unbound values_undef subquery order_unbound group_concat group_unbound_key path_plus path_star fn_strings fn_casts construct update reason_owl2rl prepared".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", SOME)
def test_like_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{TINY}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = queries.queries()[name](spark, TINY)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.oracle_sql()) <= set(queries.queries()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """Filters and columns reach the scan, and each table is read once."""
    df = queries.queries()["filter_range"](spark, TINY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in plan and "o_orderpriority" not in plan
    plan = queries.queries()["bgp_star"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and plan.count("FileScan") == 1
    plan = queries.queries()["revenue_by_nation"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_exists_optional_plan(spark):
    """The optional part isn't paired with each value of the outer pattern."""
    plan = queries.queries()["exists_optional"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_triangle_plan(spark):
    """Suppliers and customers, who share a nation only, aren't paired: lines lead from one to the other."""
    plan = queries.queries()["bgp_triangle"](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and sum("_k#" in line for line in joins) == 1 and "_c#" in next(line for line in joins if "_k#" in line)


def test_benchmark_graphs(spark):
    from ternion.engine import Engine
    from ternion.sources import generators

    shop = Engine(spark)
    shop.load_frame(generators.shop(spark, 60).persist())
    assert 60 * 100 < shop.stats()["triples"] < 60 * 180
    counts = {n: shop.sparql(t).count() for n, t in generators.SHOP_QUERIES.items()}
    assert counts["shop_q5"] == 1 and counts["shop_q7"] == 20 and counts["shop_q9"] > 10 and min(counts.values()) >= 0
