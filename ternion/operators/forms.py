"""CONSTRUCT templates and DESCRIBE as triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.errors import LimitError
from ternion.functions.values import as_term
from ternion.plans.algebra import Query, Triple
from ternion.plans.checkpoints import saved
from ternion.plans.dataset import Dataset
from ternion.plans.solution import Info, Solution
from ternion.sources.store import COLUMNS
from ternion.terms import IRI, Blank, Var

#: Levels of blank nodes that DESCRIBE follows.
MOST_LEVELS = 100


def _cell(x: object, sol: Solution, row_id: Column | None) -> Column:
    """A template's term as a TERM column; NULL where its variable is unbound.  Blank nodes are new for each row."""
    if isinstance(x, Var):
        return as_term(sol.value(x.name)) if x.name in sol.infos else F.lit(None).cast(t.TERM)
    if isinstance(x, Blank):
        label = F.concat(F.lit(f"{x.label}r"), row_id.cast("string"))
        return F.struct(F.lit(t.BLANK).alias("k"), label.alias("v"), F.lit("").alias("dt"), F.lit("").alias("lang"))
    k, v, dt, lang = t.row(t.canonical(x))
    return F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(dt).alias("dt"), F.lit(lang).alias("lang"))


def instantiate(template: tuple[Triple, ...], sol: Solution, parts: int = 1) -> DataFrame:
    """The distinct triples (columns of the store) of a template over all solutions.

    Triples with an unbound part, a literal subject or a predicate that is no IRI are left out.
    parts: tasks among which they are dealt out to be told apart; 1 leaves it to Spark, which goes by compressed bytes.
    """
    blank = any(isinstance(x, Blank) for tr in template for x in (tr.s, tr.o))
    df = sol.df.withColumn("_row", F.monotonically_increasing_id()) if blank else sol.df
    row_id = F.col("_row") if blank else None
    made = [F.struct(_cell(tr.s, sol, row_id).alias("s"), _cell(tr.p, sol, row_id).alias("p"), _cell(tr.o, sol, row_id).alias("o")) for tr in template]
    rows = df.select(F.explode(F.array(*made)).alias("t")).filter(f"t.s is not null and t.p is not null and t.o is not null and t.s.k <> {t.LITERAL} and t.p.k = {t.IRI_KIND}")
    rows = rows.select(F.col("t.s.k").alias("sk"), F.col("t.s.v").alias("s"), F.col("t.p.v").alias("p"), F.col("t.o.k").alias("k"), F.col("t.o.v").alias("v"), F.col("t.o.dt").alias("dt"), F.col("t.o.lang").alias("lang"))
    return (rows.repartition(parts, *COLUMNS) if parts > 1 else rows).distinct()


def _as_triples(sol: Solution, parts: int = 1) -> DataFrame:
    """Solutions of _s, _p, _o as triples."""
    return instantiate((Triple(Var("_s"), Var("_p"), Var("_o")),), sol, parts)


def all_triples(data: Dataset) -> DataFrame:
    parts = data.mapping.parts() if data.mapping is not None and data.store is None else 1
    return _as_triples(data.match(Triple(Var("_s"), Var("_p"), Var("_o"))), parts)


def describe(query: Query, sol: Solution | None, data: Dataset) -> DataFrame:
    """The concise bounded description of the targets: their triples and, through blank nodes, those of what they hold."""
    found = []
    for target in query.targets:
        if isinstance(target, IRI):
            found.append(_as_triples(_with_subject(data.match(Triple(target, Var("_p"), Var("_o"))), target)))
    named = [x.name for x in query.targets if isinstance(x, Var) and sol is not None and x.name in sol.infos]
    every = all_triples(data) if named or data.store is not None else None
    if named:
        wanted = reduce(DataFrame.unionAll, (sol.df.select(as_term(sol.value(n)).alias("n")) for n in named)).filter("n is not null").distinct()
        keys = wanted.select(F.col("n.k").alias("_k"), F.col("n.v").alias("_v"))
        found.append(every.join(keys, (F.col("sk") == F.col("_k")) & (F.col("s") == F.col("_v")), "left_semi"))
    if not found:
        return data.nothing([]).df.select(*(F.lit(None).cast("int" if c in ("sk", "k") else "string").alias(c) for c in COLUMNS))
    known = reduce(DataFrame.unionAll, found).distinct()
    if data.store is None:
        return known  # mapped tables have no blank nodes
    known = saved(known, "described")
    done = None
    for _ in range(MOST_LEVELS):
        blanks = known.filter(F.col("k") == t.BLANK).select(F.col("v").alias("_v")).distinct()
        if done is not None:
            blanks = blanks.join(done, "_v", "left_anti")
        blanks = saved(blanks, "blanks")
        if blanks.isEmpty():
            return known
        done = blanks if done is None else done.union(blanks)
        more = every.join(blanks, (F.col("sk") == t.BLANK) & (F.col("s") == F.col("_v")), "left_semi")
        known = saved(known.unionAll(more).distinct(), "described")
    raise LimitError(f"blank nodes are nested more than {MOST_LEVELS} deep")


def _with_subject(sol: Solution, subject: IRI) -> Solution:
    return Solution(sol.df.withColumn("_s", F.lit(subject.value)), sol.infos | {"_s": Info("iri")})
