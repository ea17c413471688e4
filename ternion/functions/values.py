"""Typed columns: what the planner knows about a variable or an expression.

A column is native (bigint, double, string, boolean, timestamp, date, or an IRI's text or key) where
its kind is known, so that filters reach the scan and joins compare plain values; else it is a TERM
struct.  NULL is unbound, or an error in an expression.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternion import terms as t

#: Kinds of native columns with their datatypes.
DATATYPES = {"integer": t.INTEGER, "decimal": t.DECIMAL, "double": t.DOUBLE, "string": t.STRING, "boolean": t.BOOLEAN, "dateTime": t.DATE_TIME, "date": t.DATE}
NUMBERS = {"integer": 0, "decimal": 1, "double": 3}


@dataclass(frozen=True)
class Template:
    """IRIs made of a prefix and a key: the column holds the key alone."""

    prefix: str
    type: str  # Spark type of the key

    def key(self, iri: str) -> str | None:
        """The key of an IRI, or None if it is none of these."""
        if not iri.startswith(self.prefix):
            return None
        key = iri[len(self.prefix) :]
        if self.type in ("int", "bigint"):
            return key if key.lstrip("-").isdigit() and str(int(key)) == key else None
        return key


@dataclass(frozen=True)
class Value:
    kind: str  # a key of DATATYPES, or iri, term, numeric (double with a rank), unbound
    col: Column
    template: Template | None = None
    rank: Column | None = None
    nullable: bool = True
    term: t.Term | None = None  # of a constant

    def same_form(self, other: Value) -> bool:
        return self.kind == other.kind and self.template == other.template and self.kind != "numeric"


def null(kind: str = "unbound") -> Value:
    return Value(kind, F.lit(None).cast("string"))


def constant(term: t.Term) -> Value:
    term = t.canonical(term)
    make = lambda kind, col: Value(kind, col, nullable=False, term=term)
    if isinstance(term, t.IRI):
        return make("iri", F.lit(term.value))
    if isinstance(term, t.Literal) and not term.language:
        lex, dt = term.lexical, term.datatype
        try:
            if dt == t.STRING:
                return make("string", F.lit(lex))
            if dt == t.INTEGER and abs(int(lex)) < 1 << 63:
                return make("integer", F.lit(int(lex)).cast("bigint"))
            if dt in (t.DECIMAL, t.DOUBLE):
                return make("decimal" if dt == t.DECIMAL else "double", F.lit(float(lex)))
            if dt == t.BOOLEAN and lex in ("true", "false", "1", "0"):
                return make("boolean", F.lit(lex in ("true", "1")))
            if dt == t.DATE_TIME:
                return make("dateTime", F.lit(lex).try_cast("timestamp"))
            if dt == t.DATE:
                return make("date", F.lit(lex).try_cast("date"))
        except ValueError:
            pass
    k, v, dt, lang = t.row(term)
    return make("term", struct(F.lit(k), F.lit(v), F.lit(dt), F.lit(lang)))


def struct(k: Column, v: Column, dt: Column, lang: Column) -> Column:
    """A TERM; NULL where v is NULL."""
    return F.when(v.isNotNull(), F.struct(k.cast("int").alias("k"), v.alias("v"), dt.alias("dt"), lang.alias("lang")))


def iri_text(v: Value) -> Column:
    return F.concat(F.lit(v.template.prefix), v.col.cast("string")) if v.template else v.col


def _number_text(col: Column, rank: Column) -> Column:
    whole = F.format_string("%d", col.try_cast("bigint"))
    plain = F.regexp_replace(F.regexp_replace(col.cast("decimal(38,12)").cast("string"), r"0+$", ""), r"\.$", ".0")
    return F.when(rank == 0, F.when(col.isNotNull(), whole)).when(rank == 1, plain).otherwise(col.cast("string"))


def lexical(v: Value) -> Column:
    """STR(): an IRI's text, a blank node's label with ``_:``, a literal's lexical form."""
    if v.kind == "iri":
        return iri_text(v)
    if v.kind == "term":
        return F.when(v.col["k"] == t.BLANK, F.concat(F.lit("_:"), v.col["v"])).otherwise(v.col["v"])
    if v.kind == "numeric":
        return _number_text(v.col, v.rank)
    if v.kind == "decimal":
        return _number_text(v.col, F.lit(1))
    if v.kind == "dateTime":
        return F.concat(F.regexp_replace(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSS"), r"\.000$", ""), F.lit("Z"))
    return v.col.cast("string")


def as_term(v: Value) -> Column:
    if v.kind == "term":
        return v.col
    if v.kind == "unbound":
        return F.lit(None).cast(t.TERM)
    if v.kind == "iri":
        return struct(F.lit(t.IRI_KIND), iri_text(v), F.lit(""), F.lit(""))
    if v.kind == "numeric":
        dt = F.element_at(F.array(*(F.lit(x) for x in t.BY_RANK)), v.rank + 1)
        return struct(F.lit(t.LITERAL), F.when(v.col.isNotNull(), lexical(v)), dt, F.lit(""))
    return struct(F.lit(t.LITERAL), lexical(v), F.lit(DATATYPES[v.kind]), F.lit(""))


def _dt_rank(dt: Column) -> Column:
    by = {}
    for name, rank in t.NUMERIC.items():
        by.setdefault(rank, []).append(name)
    out = F
    for rank, names in sorted(by.items()):
        out = out.when(dt.isin(names), F.lit(rank))
    return out


def number(v: Value, lenient: bool = False) -> Value:
    """The value as a number (NULL if it is none).  lenient: plain strings that look like numbers count."""
    if v.kind in NUMBERS or v.kind == "numeric":
        return v
    if v.kind == "term":
        rank = _dt_rank(v.col["dt"])
        if lenient:
            rank = F.coalesce(rank, F.when((v.col["k"] == t.LITERAL) & (v.col["dt"] == t.STRING), F.when(v.col["v"].rlike(r"^[+-]?\d+$"), 0).otherwise(3)))
        col = F.when(rank.isNotNull(), v.col["v"].try_cast("double"))
        return Value("numeric", col, rank=F.when(col.isNotNull(), rank))
    if v.kind == "string" and lenient:
        col = v.col.try_cast("double")
        return Value("numeric", col, rank=F.when(col.isNotNull(), F.when(v.col.rlike(r"^\s*[+-]?\d+\s*$"), 0).otherwise(3)))
    return Value("double", F.lit(None).cast("double"))


def rank_of(v: Value) -> Column:
    return F.lit(NUMBERS[v.kind]) if v.kind in NUMBERS else v.rank


def string(v: Value) -> Column:
    """The text of a plain or language-tagged string; NULL for others."""
    if v.kind == "string":
        return v.col
    if v.kind == "term":
        return F.when(v.col["dt"].isin(t.STRING, t.LANG_STRING), v.col["v"])
    return F.lit(None).cast("string")


def like(v: Value, col: Column) -> Value:
    """A new string with the language of the string it was made from."""
    if v.kind == "term":
        return Value("term", F.when(col.isNotNull(), struct(F.lit(t.LITERAL), col, v.col["dt"], v.col["lang"])))
    return Value("string", col)


def timestamp(v: Value) -> Column:
    if v.kind == "dateTime":
        return v.col
    if v.kind == "term":
        return F.when(v.col["dt"] == t.DATE_TIME, v.col["v"].try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def ebv(v: Value) -> Column:
    """The effective boolean value; NULL is an error."""
    if v.kind == "boolean":
        return v.col
    if v.kind == "string":
        return F.length(v.col) > 0
    if v.kind in NUMBERS or v.kind == "numeric":
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "term":
        c, n = v.col, number(v)
        return F.when(c["dt"] == t.BOOLEAN, F.when(c["v"].isin("true", "1"), True).when(c["v"].isin("false", "0"), False)).when(c["dt"].isin(t.STRING, t.LANG_STRING), F.length(c["v"]) > 0).when(n.rank.isNotNull(), n.col != 0)
    return F.lit(None).cast("boolean")


def unified(values: list[Value]) -> list[Value]:
    """The values in one common form."""
    some = [v for v in values if v.kind != "unbound"]
    if not some:
        return values
    first = some[0]
    if all(v.same_form(first) for v in some):
        to = first.col
        return [v if v.kind != "unbound" else replace(first, col=F.when(F.lit(False), to), nullable=True, term=None) for v in values]
    if all(v.kind == "iri" for v in some):
        return [Value("iri", iri_text(v) if v.kind == "iri" else F.lit(None).cast("string"), nullable=v.nullable) for v in values]
    if all(v.kind in NUMBERS or v.kind == "numeric" for v in some):
        # mixed number types stay distinguishable: integer < decimal < double
        return [Value("numeric", v.col.cast("double"), rank=F.when(v.col.isNotNull(), rank_of(v)) if v.kind != "unbound" else F.lit(None).cast("int"), nullable=v.nullable) for v in values]
    return [Value("term", as_term(v), nullable=v.nullable) for v in values]


def stored(v: Value) -> Value:
    """The value in a form that fits into one column."""
    return Value("term", as_term(v), nullable=v.nullable) if v.kind == "numeric" else v


def key_of(v: Value, template: Template) -> Value | None:
    """A constant IRI as a key of a template; None if it is not one of its IRIs."""
    key = template.key(v.term.value) if isinstance(v.term, t.IRI) else None
    return None if key is None else Value("iri", F.lit(key).cast(template.type), template, nullable=False)


def _apart(a: Template | None, b: Template | None) -> bool:
    return bool(a and b and not a.prefix.startswith(b.prefix) and not b.prefix.startswith(a.prefix))


def same_term(a: Value, b: Value) -> Column:
    """Structural equality, the equality of joins."""
    if a.kind == "iri" and b.kind == "iri":
        if a.template == b.template:
            return a.col == b.col
        for x, y in ((a, b), (b, a)):
            if x.term is not None and y.template:
                key = key_of(x, y.template)
                return F.lit(False) if key is None else y.col == key.col
        return F.lit(False) if _apart(a.template, b.template) else iri_text(a) == iri_text(b)
    if a.same_form(b):
        if a.kind == "term" and (a.term is not None or b.term is not None):
            return (a.col["v"] == b.col["v"]) & (a.col["k"] == b.col["k"]) & (a.col["dt"] == b.col["dt"]) & (a.col["lang"] == b.col["lang"])
        return a.col == b.col
    if "term" in (a.kind, b.kind) or "numeric" in (a.kind, b.kind):
        x, y = as_term(a), as_term(b)
        if a.term is not None or b.term is not None:  # field by field, so that a scan can skip by the text
            return (x["v"] == y["v"]) & (x["k"] == y["k"]) & (x["dt"] == y["dt"]) & (x["lang"] == y["lang"])
        return x == y
    return F.lit(False)


def equal(a: Value, b: Value) -> Column:
    """The ``=`` of filters: by value for numbers, booleans and times, else the same term."""
    if "unbound" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    numeric = lambda v: v.kind in NUMBERS or v.kind == "numeric"
    if numeric(a) and numeric(b):
        return a.col == b.col
    if a.kind == "term" and b.kind == "term":
        x, y = number(a), number(b)
        other = F.when((a.col["dt"] == t.DATE_TIME) & (b.col["dt"] == t.DATE_TIME), timestamp(a) == timestamp(b)).otherwise((a.col["k"] == b.col["k"]) & (a.col["v"] == b.col["v"]) & (a.col["dt"] == b.col["dt"]) & (F.lower(a.col["lang"]) == F.lower(b.col["lang"])))
        return F.when(x.col.isNotNull() & y.col.isNotNull(), x.col == y.col).otherwise(other)
    if a.kind == "term" or b.kind == "term":
        v, n = (a, b) if a.kind == "term" else (b, a)
        known = lambda c: F.when(v.col.isNotNull(), F.coalesce(c, F.lit(False)))
        if numeric(n):
            return known(number(v).col == n.col)
        if n.kind == "dateTime":
            return known(timestamp(v) == n.col)
        if n.kind == "boolean":
            return known(F.when(v.col["dt"] == t.BOOLEAN, ebv(v) == n.col))
        return same_term(a, b)
    return F.when(a.col.isNotNull() & b.col.isNotNull(), same_term(a, b)) if not a.same_form(b) else same_term(a, b)


def compared(op: str, a: Value, b: Value) -> Column:
    """``< > <= >=``: numbers by value, times by time, other literals by text; NULL for IRIs and blank nodes."""
    apply = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    numeric = lambda v: v.kind in NUMBERS or v.kind == "numeric"
    if "unbound" in (a.kind, b.kind) or "iri" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if numeric(a) and numeric(b):
        return apply(a.col, b.col)
    if a.kind == b.kind and a.kind != "term":
        return apply(a.col, b.col)
    if "term" in (a.kind, b.kind):
        text = lambda v: F.when(v.col["k"] == t.LITERAL, v.col["v"]) if v.kind == "term" else lexical(v)
        x, y = number(a), number(b)
        out = F.when(x.col.isNotNull() & y.col.isNotNull(), apply(x.col, y.col))
        if "dateTime" in (a.kind, b.kind):
            return F.when(timestamp(a).isNotNull() & timestamp(b).isNotNull(), apply(timestamp(a), timestamp(b)))
        if numeric(a) or numeric(b):
            return out
        return out.when(x.col.isNull() & y.col.isNull(), apply(text(a), text(b)))
    if {a.kind, b.kind} <= {"dateTime", "date"}:
        return apply(a.col.cast("timestamp"), b.col.cast("timestamp"))
    return F.lit(None).cast("boolean")


def order_keys(v: Value) -> list[Column]:
    """Columns that sort like ORDER BY: unbound, blank nodes, IRIs, then literals; numbers before other literals."""
    if v.kind == "iri":
        return [iri_text(v)]
    if v.kind == "term":
        n = number(v).col
        return [v.col["k"], n.isNull() & v.col.isNotNull(), n, v.col["v"], v.col["dt"], v.col["lang"]]
    return [v.col]
