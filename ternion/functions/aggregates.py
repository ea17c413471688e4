"""SPARQL aggregates as Spark aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternion.errors import UnsupportedError
from ternion.functions import values as v
from ternion.functions.scalar import Registry, Scope, evaluate
from ternion.functions.values import Value
from ternion.plans import algebra as a
from ternion.plans.solution import Info


def aggregate(agg: a.Aggregate, scope: Scope, functions: Registry | None = None) -> list[tuple[Column, str]]:
    """Columns to aggregate, with suffixes of their names; result() puts them together."""
    if agg.name == "COUNT" and agg.arg is None:
        return [(F.count_distinct(F.struct(*(x.col for x in scope.values()))) if agg.distinct and scope else F.count(F.lit(1)), "")]
    x = evaluate(agg.arg, scope, functions)
    if agg.name == "COUNT":
        x = v.stored(x)
        return [(F.count_distinct(x.col) if agg.distinct else F.count(x.col), "")]
    if agg.name in ("SUM", "AVG"):
        n = v.number(x, lenient=True)
        if agg.name == "SUM":
            total = F.sum_distinct(n.col) if agg.distinct else F.try_sum(n.col)
        else:
            total = F.sum_distinct(n.col.cast("double")) / F.count_distinct(n.col) if agg.distinct else F.avg(n.col)
        return [(total, ""), *([(F.max(n.rank), "_rank")] if n.kind == "numeric" else [])]
    if agg.name == "GROUP_CONCAT":
        text = v.lexical(x)
        found = F.collect_set(text) if agg.distinct else F.collect_list(text)
        return [(F.array_join(F.sort_array(found), agg.separator), "")]  # sorted: Spark has no input order
    if agg.name in ("MIN", "MAX", "SAMPLE"):
        pick = F.max if agg.name == "MAX" else F.min
        x = v.stored(x)
        if x.kind in ("term", "iri"):
            held = v.iri_text(x) if x.kind == "iri" else x.col
            keys = v.order_keys(x)
            whole = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), held.alias("held"))
            return [(pick(F.when(held.isNotNull(), whole))["held"], "")]
        return [(pick(x.col), "")]
    raise UnsupportedError(f"unknown aggregate {agg.name}")


def result(agg: a.Aggregate, name: str, scope: Scope, functions: Registry | None = None) -> tuple[Value, Info]:
    """The value of an aggregate from the columns that aggregate() made."""
    col = F.col(name)
    if agg.name == "COUNT":
        return Value("integer", col, nullable=False), Info("integer")
    if agg.name == "GROUP_CONCAT":
        return Value("string", F.coalesce(col, F.lit("")), nullable=False), Info("string")
    x = v.stored(evaluate(agg.arg, scope, functions))
    if agg.name in ("SUM", "AVG"):
        n = v.number(x, lenient=True)
        if x.kind == "unbound":
            return Value("integer", F.lit(0).cast("bigint"), nullable=False), Info("integer")
        if n.kind == "numeric":
            rank = F.coalesce(F.col(name + "_rank"), F.lit(0))
            if agg.name == "AVG":
                rank = F.when(F.col(name + "_rank").isNotNull(), F.greatest(rank, F.lit(1))).otherwise(0)
            value = v.stored(Value("numeric", F.coalesce(col.cast("double"), F.lit(0.0)), rank=rank, nullable=False))
            return value, Info("term")
        kind = "decimal" if agg.name == "AVG" and n.kind == "integer" else n.kind
        zero = F.lit(0) if kind == "integer" else F.lit(0.0)
        return Value(kind, F.coalesce(col, zero.cast("bigint") if kind == "integer" else zero), nullable=False), Info(kind)
    if x.kind in ("term", "iri"):
        return Value(x.kind, col), Info(x.kind, None, True)
    return Value(x.kind, col, x.template), Info(x.kind, x.template, True)
