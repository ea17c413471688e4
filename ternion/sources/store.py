"""A set of triples as a DataFrame, with statistics that give patterns native columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.functions.values import Value, constant, same_term, struct
from ternion.plans.algebra import Triple, blank_name
from ternion.plans.checkpoints import saved
from ternion.plans.solution import Info, Solution
from ternion.terms import IRI, Blank, Term, Var

#: Columns of a triple: the subject's kind and text, the predicate, the object's kind, text, datatype, language.
SCHEMA = "sk int, s string, p string, k int, v string, dt string, lang string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Predicate:
    """What is known about a predicate's triples."""

    count: int
    subject: Info
    object: Info


def as_row(s: Term, p: IRI, o: Term) -> tuple:
    o = t.canonical(o)
    return (*t.row(s)[:2], p.value, *t.row(o))


def triples(spark: SparkSession, rows: Iterable[tuple[Term, IRI, Term]]) -> DataFrame:
    """Driver-side triples as a DataFrame."""
    return spark.createDataFrame([as_row(*r) for r in rows], SCHEMA)


class TripleStore:
    """An immutable version of a graph: changes give new versions, so readers keep what they had."""

    def __init__(self, df: DataFrame, changes: int = 0):
        self.df, self.changes = df, changes
        self._predicates: dict[str, Predicate] | None = None

    @staticmethod
    def empty(spark: SparkSession) -> TripleStore:
        store = TripleStore(spark.createDataFrame([], SCHEMA))
        store._predicates = {}
        return store

    @property
    def predicates(self) -> dict[str, Predicate]:
        """Statistics by predicate, gathered once for a version; as many rows as there are predicates."""
        if self._predicates is None:
            found = self.df.groupBy("p").agg(
                F.count("*").alias("n"), F.min("sk").alias("sk"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("dt").alias("d0"), F.max("dt").alias("d1"), F.max(F.length("v")).alias("long")
            )
            self._predicates = {}
            for r in found.collect():
                kind = "term"
                if r.k0 == r.k1 == t.IRI_KIND:
                    kind = "iri"
                elif r.k0 == r.k1 == t.LITERAL and r.d0 == r.d1:
                    kind = "string" if r.d0 == t.STRING else "integer" if r.d0 == t.INTEGER and r.long <= 18 else "term"
                self._predicates[r.p] = Predicate(r.n, Info("iri" if r.sk == t.IRI_KIND else "term"), Info(kind))
        return self._predicates

    def is_empty(self) -> bool:
        return not self.predicates

    def changed(self, df: DataFrame) -> TripleStore:
        """The next version; every tenth one is saved to keep lineages short."""
        new = TripleStore(df.select(*COLUMNS), self.changes + 1)
        if new.changes % 10 == 0:
            new.df = saved(new.df, "triples")
        else:
            new.df = new.df.persist()
        return new

    def plus(self, more: DataFrame) -> TripleStore:
        """With more triples; a graph is a set, so known ones change nothing."""
        return self.changed(self.df.unionByName(more.select(*COLUMNS)).dropDuplicates(COLUMNS))

    def less(self, gone: DataFrame) -> TripleStore:
        keys = gone.select(*COLUMNS).distinct()
        return self.changed(self.df.join(keys, COLUMNS, "left_anti"))

    def match(self, triple: Triple) -> Solution | None:
        """Solutions of one pattern; None if a predicate is not in the graph."""
        s, p, o = triple.s, triple.p, triple.o
        df = self.df
        stats = list(self.predicates.values())
        if isinstance(p, IRI):
            known = self.predicates.get(p.value)
            if known is None:
                return None
            df = df.filter(F.col("p") == p.value)
            s_info, o_info = known.subject, known.object
        elif isinstance(p, t.Literal):
            return None
        else:
            s_info = Info("iri" if all(x.subject.kind == "iri" for x in stats) else "term")
            o_info = Info("iri" if stats and all(x.object.kind == "iri" for x in stats) else "term")
        subject = Value("iri", F.col("s"), nullable=False) if s_info.kind == "iri" else Value("term", struct(F.col("sk"), F.col("s"), F.lit(""), F.lit("")), nullable=False)
        col = F.col("v").cast("bigint") if o_info.kind == "integer" else F.col("v") if o_info.kind in ("iri", "string") else struct(F.col("k"), F.col("v"), F.col("dt"), F.col("lang"))
        value = Value(o_info.kind, col, nullable=False)
        out: dict[str, Value] = {}
        for x, v in ((s, subject), (p, Value("iri", F.col("p"), nullable=False)), (o, value)):
            if isinstance(x, Var | Blank):
                name = x.name if isinstance(x, Var) else blank_name(x)
                if name in out:
                    df = df.filter(same_term(out[name], v))
                else:
                    out[name] = v
            elif x is s:
                df = df.filter(F.lit(False) if isinstance(s, t.Literal) else (F.col("s") == s.value) & (F.col("sk") == t.IRI_KIND))
            elif x is o:
                k, text, dt, lang = t.row(t.canonical(o))
                df = df.filter((F.col("v") == text) & (F.col("k") == k) & (F.col("dt") == dt) & (F.col("lang") == lang))
        cols = [v.col.alias(n) for n, v in out.items()]
        return Solution(df.select(*cols) if cols else df.select(F.lit(1).alias("_one")), {n: Info(v.kind) for n, v in out.items()})

    def size(self, triple: Triple) -> float:
        """Estimated triples that match a pattern."""
        if isinstance(triple.p, IRI):
            known = self.predicates.get(triple.p.value)
            n = known.count if known else 0
        else:
            n = sum(x.count for x in self.predicates.values())
        if not isinstance(triple.s, Var | Blank):
            n = min(n, 5)
        if not isinstance(triple.o, Var | Blank):
            n = n / 20
        return n

    def nodes(self) -> DataFrame:
        """All subjects and objects as a column n of TERM structs, each once."""
        s = self.df.select(struct(F.col("sk"), F.col("s"), F.lit(""), F.lit("")).alias("n"))
        o = self.df.select(struct(F.col("k"), F.col("v"), F.col("dt"), F.col("lang")).alias("n"))
        return s.unionAll(o).distinct()


def constant_of(term: Term) -> Value:
    return constant(term)
