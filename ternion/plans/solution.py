"""Solution sequences: a DataFrame with a column for each variable and what is known about each."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.functions.values import Template, Value, as_term, iri_text, key_of, lexical, stored

#: Spark types of native columns.
SPARK_TYPES = {"integer": "bigint", "decimal": "double", "double": "double", "string": "string", "boolean": "boolean", "dateTime": "timestamp", "date": "date", "iri": "string", "term": t.TERM, "unbound": "string"}


@dataclass(frozen=True)
class Info:
    kind: str
    template: Template | None = None
    nullable: bool = False

    def maybe(self) -> Info:
        return replace(self, nullable=True)


@dataclass(frozen=True)
class Solution:
    df: DataFrame
    infos: dict[str, Info]

    def value(self, name: str) -> Value:
        info = self.infos[name]
        return Value(info.kind, F.col(name), info.template, nullable=info.nullable)

    @property
    def scope(self) -> dict[str, Value]:
        return {n: self.value(n) for n in self.infos}

    def filter(self, c: Column) -> Solution:
        return replace(self, df=self.df.filter(c))

    def with_value(self, name: str, value: Value) -> Solution:
        value = stored(value)
        return Solution(self.df.withColumn(name, value.col), self.infos | {name: Info(value.kind, value.template, value.nullable)})

    def only(self, names: list[str]) -> Solution:
        return Solution(self.df.select(*names) if names else self.df.select(F.lit(1).alias("_one")), {n: self.infos[n] for n in names})

    def cast(self, to: dict[str, Info]) -> Solution:
        """The same solutions with the variables in the given forms; missing ones unbound."""
        cols = [in_form(self.value(n), i).alias(n) if n in self.infos else F.lit(None).cast(spark_type(i)).alias(n) for n, i in to.items()]
        return Solution(self.df.select(*cols) if cols else self.df.select(F.lit(1).alias("_one")), to)

    def lexical(self) -> DataFrame:
        """All variables as text."""
        return self.df.select(*(lexical(self.value(n)).alias(n) for n in self.infos))

    def terms(self) -> DataFrame:
        """All variables as TERM structs."""
        return self.df.select(*(as_term(self.value(n)).alias(n) for n in self.infos))


def spark_type(info: Info) -> str:
    return info.template.type if info.template else SPARK_TYPES[info.kind]


def in_form(v: Value, info: Info) -> Column:
    """A value's column in the form of info."""
    if (v.kind, v.template) == (info.kind, info.template):
        return v.col
    if v.kind == "unbound":
        return F.lit(None).cast(spark_type(info))
    if info.kind == "iri":
        if info.template:
            if v.term is not None:
                key = key_of(v, info.template)
                return F.lit(None).cast(info.template.type) if key is None else key.col
            text = iri_text(v)
            rest = F.when(F.startswith(text, F.lit(info.template.prefix)), F.substring(text, len(info.template.prefix) + 1, 1 << 30))
            key = rest.try_cast(info.template.type)
            return F.when(key.cast("string") == rest, key)
        return iri_text(v)
    return as_term(v)


def common(a: Info, b: Info) -> Info:
    """A form that holds the values of both; nullable if either is."""
    nullable = a.nullable or b.nullable
    if a.kind == "unbound" or b.kind == "unbound":
        return replace(b if a.kind == "unbound" else a, nullable=True)
    if (a.kind, a.template) == (b.kind, b.template):
        return replace(a, nullable=nullable)
    if a.kind == b.kind == "iri":
        return Info("iri", None, nullable)
    return Info("term", None, nullable)


def meeting(a: Info, b: Info) -> Info | None:
    """The form in which two columns are compared in a join; None if their values are never the same term."""
    if "unbound" in (a.kind, b.kind):
        return common(a, b)
    if a.kind == b.kind == "iri" and a.template != b.template:
        if a.template and b.template:
            apart = not a.template.prefix.startswith(b.template.prefix) and not b.template.prefix.startswith(a.template.prefix)
            return None if apart else Info("iri")
        return Info("iri", a.template or b.template)
    if a.kind != b.kind and "term" not in (a.kind, b.kind):
        return None
    return common(a, b)
