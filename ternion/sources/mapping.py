"""Existing tables as a graph: patterns over one subject become one scan of its table."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.functions.values import Template, Value, as_term, constant, same_term
from ternion.operators.joins import union
from ternion.plans.algebra import Triple, blank_name
from ternion.plans.solution import Info, Solution
from ternion.terms import IRI, Blank, Var

#: Bytes of a table's files times its fields that one task takes when every field becomes a triple: a tenth of what they take in memory or less.
CELL_BYTES = 8 << 20
#: Partitions beyond which a size is taken for unknown (as of a table in memory).
MOST_PARTS = 100_000

_KINDS = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "double", "double": "double", "string": "string", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}


@dataclass(frozen=True)
class Field:
    """A column that is a predicate's object: a literal, or an IRI made of the column and a prefix."""

    column: str
    info: Info


@dataclass
class Table:
    """A table seen as triples: one subject for each row, a predicate for each field."""

    df: DataFrame
    subject: str  # prefix of its subjects
    type: str | None = None  # class of its subjects
    key: str | None = None  # None: each row is a subject of its own
    fields: dict[str, Field] = field(default_factory=dict)

    @property
    def template(self) -> Template:
        return Template(self.subject, dict(self.df.dtypes)[self.key] if self.key else "string")


def table(df: DataFrame, name: str, key: str | None, base: str, links: dict[str, str] | None = None) -> Table:
    """Maps a table by convention: subjects base/name/key, predicates base/column; links names the tables that columns refer to."""
    types = dict(df.dtypes)
    fields = {}
    for column, kind in types.items():
        if links and column in links:
            fields[base + column] = Field(column, Info("iri", Template(f"{base}{links[column]}/", kind)))
        elif kind in _KINDS:
            fields[base + column] = Field(column, Info(_KINDS[kind]))
    return Table(df, f"{base}{name}/", base + name.capitalize(), key, fields)


def _bytes(tab: Table) -> float:
    """A table's size from its plan's statistics."""
    return float(str(tab.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _parts(tab: Table) -> int:
    """Tasks among which a table's triples are dealt out: compressed files hold many more rows than their bytes tell.  1: as it comes."""
    n = math.ceil(_bytes(tab) * (len(tab.fields) + 1) / CELL_BYTES)
    return n if n <= MOST_PARTS else 1


class Mapping:
    """The graph of some tables."""

    def __init__(self, tables: list[Table]):
        self.tables = tables

    def _column(self, f: Field) -> Column:
        c = F.col(f.column)
        return c.cast("bigint") if f.info.kind == "integer" else c.cast("double") if f.info.kind == "double" else c

    def _identified(self, tab: Table) -> DataFrame:
        """The rows with their subject key in _key; rows without a key are told apart by all they hold."""
        if tab.key:
            return tab.df.withColumn("_key", F.col(tab.key))
        plain = [c for c, kind in tab.df.dtypes if not kind.startswith("map")]
        h = F.hex(F.xxhash64(*plain))
        same = F.row_number().over(Window.partitionBy("_h").orderBy(F.lit(1)))
        return tab.df.withColumn("_h", h).withColumn("_key", F.concat_ws("-", "_h", same.cast("string"))).drop("_h")

    def star(self, subject: object, pairs: list[tuple[object, object]], need_subject: bool = True) -> Solution | None:
        """Solutions of the patterns (subject, predicate, object) over one subject; None if no table has them."""
        if any(isinstance(p, Var) for p, _ in pairs):
            free = [(p, o) for p, o in pairs if isinstance(p, Var)]
            assert len(pairs) == 1 and free
            found = [s for tab in self.tables if (s := self._any(tab, subject, *free[0]))]
        else:
            found = [s for tab in self.tables if (s := self._one(tab, subject, pairs, need_subject))]
        return reduce(union, found) if found else None

    def _one(self, tab: Table, subject: object, pairs: list, need_subject: bool) -> Solution | None:
        for p, o in pairs:
            if p.value == t.TYPE:
                if tab.type is None or isinstance(o, IRI) and o.value != tab.type or isinstance(o, t.Literal):
                    return None
            elif p.value not in tab.fields:
                return None
        need = need_subject or not isinstance(subject, Var | Blank)
        df = self._identified(tab) if need else tab.df
        out: dict[str, Value] = {}
        tests: list[Column] = []
        if isinstance(subject, IRI):
            key = tab.template.key(subject.value)
            if key is None:
                return None
            tests.append(F.col("_key") == F.lit(key).cast(tab.template.type))
        elif isinstance(subject, t.Literal):
            return None
        elif need:
            name = subject.name if isinstance(subject, Var) else blank_name(subject)
            out[name] = Value("iri", F.col("_key"), tab.template, nullable=False)
            tests.append(F.col("_key").isNotNull())
        for p, o in pairs:
            if p.value == t.TYPE:
                value = Value("iri", F.lit(tab.type), nullable=False)
            else:
                f = tab.fields[p.value]
                value = Value(f.info.kind, self._column(f), f.info.template, nullable=False)
                tests.append(F.col(f.column).isNotNull())
            if isinstance(o, Var | Blank):
                name = o.name if isinstance(o, Var) else blank_name(o)
                if name in out:
                    tests.append(same_term(out[name], value))
                else:
                    out[name] = value
            elif p.value != t.TYPE:
                tests.append(same_term(value, constant(o)))
        for c in tests:
            df = df.filter(c)
        cols = [x.col.alias(n) for n, x in out.items()]
        return Solution(df.select(*cols) if cols else df.select(F.lit(1).alias("_one")), {n: Info(x.kind, x.template) for n, x in out.items()})

    def _any(self, tab: Table, subject: object, p: Var, o: object) -> Solution | None:
        """A pattern with a free predicate: every field of every row."""
        df = self._identified(tab)
        if isinstance(subject, IRI):
            key = tab.template.key(subject.value)
            if key is None:
                return None
            df = df.filter(F.col("_key") == F.lit(key).cast(tab.template.type))
        elif isinstance(subject, t.Literal):
            return None
        if tab.key and (parts := _parts(tab)) > 1:  # rows without a key come from a shuffle of their own
            df = df.repartition(parts, "_key")
        cells = [F.struct(F.lit(name).alias("p"), as_term(Value(f.info.kind, self._column(f), f.info.template)).alias("o")) for name, f in tab.fields.items()]
        if tab.type:
            cells.append(F.struct(F.lit(t.TYPE).alias("p"), as_term(Value("iri", F.lit(tab.type))).alias("o")))
        df = df.select("_key", F.explode(F.array(*cells)).alias("c")).filter("_key is not null and c.o is not null").select("_key", "c.p", "c.o")
        out: dict[str, Value] = {}
        if isinstance(subject, Var | Blank):
            out[subject.name if isinstance(subject, Var) else blank_name(subject)] = Value("iri", F.col("_key"), tab.template, nullable=False)
        for x, value in ((p, Value("iri", F.col("p"), nullable=False)), (o, Value("term", F.col("o"), nullable=False))):
            if isinstance(x, Var | Blank):
                name = x.name if isinstance(x, Var) else blank_name(x)
                if name in out:
                    df = df.filter(same_term(out[name], value))
                else:
                    out[name] = value
            else:
                df = df.filter(same_term(value, constant(x)))
        return Solution(df.select(*(x.col.alias(n) for n, x in out.items())), {n: Info(x.kind, x.template) for n, x in out.items()})

    def match(self, triple: Triple) -> Solution | None:
        return self.star(triple.s, [(triple.p, triple.o)])

    def _having(self, pairs: list[tuple[object, object]]) -> list[Table]:
        """The tables that have these predicates."""
        return [tab for tab in self.tables if all(isinstance(p, Var) or p.value in tab.fields or p.value == t.TYPE and (not isinstance(o, IRI) or o.value == tab.type) for p, o in pairs)]

    def size(self, pairs: list[tuple[object, object]]) -> float:
        """Bytes of the tables that have these predicates, from their plans' statistics; no job is run."""
        return sum(_bytes(tab) for tab in self._having(pairs))

    def parts(self) -> int:
        """Tasks among which all triples are dealt out."""
        return sum(_parts(tab) for tab in self.tables)

    def keyed(self, pairs: list[tuple[object, object]]) -> bool:
        """Whether a subject of these predicates is taken to have one row; only the order of joins rests on it."""
        return all(tab.key for tab in self._having(pairs))
