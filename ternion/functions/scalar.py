"""SPARQL expressions as Spark columns: built-in functions only, so they stay inside generated code."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.errors import UnsupportedError
from ternion.functions import values as v
from ternion.functions.values import Value
from ternion.plans import algebra as a

Scope = dict[str, Value]
#: User functions by IRI: they get the arguments' lexical forms as columns and return a string column.
Registry = dict[str, Callable[..., Column]]

_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]")
MOST_PATTERN = 1000


def evaluate(e: object, scope: Scope, functions: Registry | None = None) -> Value:
    """An expression over the variables in scope; NULL where evaluating it is an error."""
    if isinstance(e, a.Ref):
        return scope.get(e.name, v.null())
    if isinstance(e, a.Const):
        return v.constant(e.term)
    if not isinstance(e, a.Call):
        raise UnsupportedError(f"{type(e).__name__} can't be used here")
    args = [evaluate(x, scope, functions) for x in e.args]
    if e.op in _FUNCTIONS:
        return _FUNCTIONS[e.op](*args)
    if e.op.startswith(t.XSD):
        return _cast(e.op, *args)
    if functions and e.op in functions:
        return Value("string", functions[e.op](*(v.lexical(x) for x in args)))
    raise UnsupportedError(f"unknown function <{e.op}>")


def condition(e: object, scope: Scope, functions: Registry | None = None) -> Column:
    """An expression as a filter: TRUE keeps, FALSE and NULL (an error) don't."""
    return v.ebv(evaluate(e, scope, functions))


def _bool(c: Column) -> Value:
    return Value("boolean", c)


def _int(c: Column) -> Value:
    return Value("integer", c.cast("bigint"))


def _arithmetic(op: str) -> Callable[[Value, Value], Value]:
    whole = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
    real = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide}

    def apply(x: Value, y: Value) -> Value:
        x, y = v.number(x), v.number(y)
        if x.kind == y.kind == "integer" and op != "/":
            return Value("integer", whole[op](x.col, y.col))
        col = real[op](x.col.cast("double"), y.col.cast("double"))
        if "numeric" in (x.kind, y.kind):
            least = [F.lit(1)] if op == "/" else []
            return Value("numeric", col, rank=F.when(col.isNotNull(), F.greatest(v.rank_of(x), v.rank_of(y), *least)))
        return Value("double" if "double" in (x.kind, y.kind) else "decimal", col)

    return apply


def _rounded(whole: Callable[[Column], Column]) -> Callable[[Value], Value]:
    def apply(x: Value) -> Value:
        x = v.number(x)
        return x if x.kind == "integer" else Value(x.kind, whole(x.col).cast("double"), rank=x.rank)

    return apply


def _signed(change: Callable[[Column], Column]) -> Callable[[Value], Value]:
    def apply(x: Value) -> Value:
        x = v.number(x)
        return Value(x.kind, change(x.col), rank=x.rank)

    return apply


def _if(c: Value, x: Value, y: Value) -> Value:
    test = v.ebv(c)
    x, y = v.unified([x, y])
    rank = F.when(test, x.rank).when(~test, y.rank) if x.kind == "numeric" else None
    return Value(x.kind, F.when(test, x.col).when(~test, y.col), x.template, rank)


def _coalesce(*xs: Value) -> Value:
    if not xs:
        return v.null()
    xs = v.unified(list(xs))
    rank = F.coalesce(*(x.rank for x in xs)) if xs[0].kind == "numeric" else None
    return Value(xs[0].kind, F.coalesce(*(x.col for x in xs)), xs[0].template, rank, nullable=all(x.nullable for x in xs))


def _in(x: Value, *ys: Value) -> Value:
    # the error of one candidate doesn't spoil the others
    out = F.lit(False)
    for y in ys:
        out = out | v.equal(x, y)
    return _bool(F.when(x.col.isNotNull(), out))


def _lang(x: Value) -> Value:
    if x.kind == "term":
        return Value("string", F.when(x.col["k"] == t.LITERAL, x.col["lang"]))
    return Value("string", F.when(x.col.isNotNull(), "") if x.kind not in ("iri", "unbound") else F.lit(None).cast("string"))


def _datatype(x: Value) -> Value:
    term = v.as_term(x)
    return Value("iri", F.when(term["k"] == t.LITERAL, term["dt"]))


def _iri(x: Value) -> Value:
    return x if x.kind == "iri" else Value("iri", F.when(x.col["k"] == t.IRI_KIND, x.col["v"]).otherwise(v.string(x)) if x.kind == "term" else v.string(x))


def _bnode(*xs: Value) -> Value:
    label = F.concat(F.lit("b"), v.string(xs[0])) if xs else F.concat(F.lit("b"), F.regexp_replace(F.uuid(), "-", ""))
    return Value("term", v.struct(F.lit(t.BLANK), label, F.lit(""), F.lit("")))


def _is_kind(*kinds: int) -> Callable[[Value], Value]:
    def apply(x: Value) -> Value:
        if x.kind == "term":
            return _bool(x.col["k"].isin(*kinds))
        own = t.IRI_KIND if x.kind == "iri" else t.LITERAL
        return _bool(F.when(x.col.isNotNull(), F.lit(x.kind != "unbound" and own in kinds)))

    return apply


def _is_numeric(x: Value) -> Value:
    return _bool(F.when(x.col.isNotNull(), v.number(x).col.isNotNull()))


def _substr(x: Value, start: Value, *length: Value) -> Value:
    first = F.greatest(v.number(start).col.cast("int"), F.lit(1))
    n = F.greatest(v.number(length[0]).col.cast("int"), F.lit(0)) if length else F.lit(2147483647)
    return v.like(x, F.substring(v.string(x), first, n))


def _text(change: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda x: v.like(x, change(v.string(x)))


def _test(test: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    return lambda x, y: _bool(test(v.string(x), v.string(y)))


def _before(x: Value, y: Value) -> Value:
    s, part = v.string(x), v.string(y)
    at = F.position(part, s)
    return v.like(x, F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.when(s.isNotNull() & part.isNotNull(), "")))


def _after(x: Value, y: Value) -> Value:
    s, part = v.string(x), v.string(y)
    at = F.position(part, s)
    return v.like(x, F.when(at > 0, F.substring(s, at + F.length(part), F.lit(2147483647))).otherwise(F.when(s.isNotNull() & part.isNotNull(), "")))


def _encode(x: Value) -> Value:
    # what SPARQL leaves as it is: letters, digits, - _ . ~
    text = F.url_encode(v.string(x))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return Value("string", text)


def _langmatches(x: Value, y: Value) -> Value:
    tag, wanted = F.lower(v.string(x)), F.lower(v.string(y))
    return _bool(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))))


def _pattern(p: Value, flags: tuple[Value, ...]) -> Column | None:
    """A pattern with its flags; None if it is too long or could take forever."""
    if isinstance(p.term, t.Literal):
        text = p.term.lexical
        if len(text) > MOST_PATTERN or _NESTED.search(text):
            return None
        try:
            re.compile(text)
        except re.error:
            return None
    if not flags:
        return v.string(p)
    letters = F.regexp_replace(v.string(flags[0]), "[^imsx]", "")
    return F.concat(F.when(F.length(letters) > 0, F.concat(F.lit("(?"), letters, F.lit(")"))).otherwise(""), v.string(p))


def _regex(x: Value, p: Value, *flags: Value) -> Value:
    pattern = _pattern(p, flags)
    return _bool(F.lit(None).cast("boolean") if pattern is None else F.rlike(v.string(x), pattern))


def _replace(x: Value, p: Value, r: Value, *flags: Value) -> Value:
    pattern = _pattern(p, flags)
    return v.like(x, F.lit(None).cast("string") if pattern is None else F.regexp_replace(v.string(x), pattern, v.string(r)))


def _part(get: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda x: _int(get(v.timestamp(x)))


def _tz(x: Value) -> Column:
    if x.kind == "dateTime":
        return F.when(x.col.isNotNull(), "Z")
    return F.when(x.col["dt"] == t.DATE_TIME, F.regexp_extract(x.col["v"], r"(Z|[+-]\d\d:\d\d)$", 1)) if x.kind == "term" else F.lit(None).cast("string")


def _timezone(x: Value) -> Value:
    zone = _tz(x)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    spelled = F.concat(F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    text = F.when((zone == "Z") | (hours + minutes == 0), "PT0S").when(zone != "", spelled)
    return Value("term", v.struct(F.lit(t.LITERAL), text, F.lit(t.XSD + "dayTimeDuration"), F.lit("")))


def _hash(digest: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda x: Value("string", digest(v.string(x).cast("binary")))


def _cast(datatype: str, x: Value) -> Value:
    """Casts to XML Schema types; NULL where the value has no such form."""
    name, text = datatype[len(t.XSD) :], F.trim(v.lexical(x)) if x.kind != "iri" else (v.iri_text(x) if datatype == t.STRING else F.lit(None).cast("string"))
    if name in ("integer", "int", "long", "short", "byte"):
        n = v.number(x)
        if x.kind in v.NUMBERS:
            return _int(n.col.try_cast("bigint"))
        by_value = F.when(n.col.isNotNull(), n.col.try_cast("bigint")).when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).when(text == "true", F.lit(1)).when(text == "false", F.lit(0))
        return _int(by_value)
    if name in ("decimal", "double", "float"):
        n = v.number(x)
        col = n.col.cast("double") if x.kind in v.NUMBERS else F.coalesce(n.col, F.when(text.isin("true", "false"), (text == "true").cast("double")).otherwise(text.try_cast("double")))
        return Value("decimal" if name == "decimal" else "double", col)
    if name == "boolean":
        n = v.number(x)
        return _bool(F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(n.col != 0))
    if name == "string":
        return Value("string", text)
    if name == "dateTime":
        return Value("dateTime", x.col if x.kind == "dateTime" else x.col.cast("timestamp") if x.kind == "date" else text.try_cast("timestamp"))
    if name == "date":
        return Value("date", x.col.cast("date") if x.kind in ("date", "dateTime") else text.try_cast("date"))
    raise UnsupportedError(f"no cast to <{datatype}>")


_FUNCTIONS: dict[str, Callable[..., Value]] = {
    "+": _arithmetic("+"),
    "-": _arithmetic("-"),
    "*": _arithmetic("*"),
    "/": _arithmetic("/"),
    "neg": _signed(lambda c: -c),
    "pos": _signed(lambda c: c),
    "=": lambda x, y: _bool(v.equal(x, y)),
    "!=": lambda x, y: _bool(~v.equal(x, y)),
    **{op: (lambda op: lambda x, y: _bool(v.compared(op, x, y)))(op) for op in ("<", ">", "<=", ">=")},
    "&&": lambda x, y: _bool(v.ebv(x) & v.ebv(y)),
    "||": lambda x, y: _bool(v.ebv(x) | v.ebv(y)),
    "!": lambda x: _bool(~v.ebv(x)),
    "IN": _in,
    "BOUND": lambda x: _bool(x.col.isNotNull()),
    "IF": _if,
    "COALESCE": _coalesce,
    "SAMETERM": lambda x, y: _bool(v.same_term(x, y)),
    "STR": lambda x: Value("string", F.when(x.col["k"] != t.BLANK, x.col["v"]) if x.kind == "term" else v.lexical(x)),
    "LANG": _lang,
    "DATATYPE": _datatype,
    "IRI": _iri,
    "BNODE": _bnode,
    "STRLANG": lambda x, y: Value("term", v.struct(F.lit(t.LITERAL), v.string(x), F.lit(t.LANG_STRING), v.string(y))),
    "STRDT": lambda x, y: Value("term", v.struct(F.lit(t.LITERAL), v.string(x), v.iri_text(_iri(y)), F.lit(""))),
    "UUID": lambda: Value("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: Value("string", F.uuid()),
    "ISIRI": _is_kind(t.IRI_KIND),
    "ISBLANK": _is_kind(t.BLANK),
    "ISLITERAL": _is_kind(t.LITERAL),
    "ISNUMERIC": _is_numeric,
    "STRLEN": lambda x: _int(F.char_length(v.string(x))),
    "SUBSTR": _substr,
    "UCASE": _text(F.upper),
    "LCASE": _text(F.lower),
    "STRSTARTS": _test(F.startswith),
    "STRENDS": _test(F.endswith),
    "CONTAINS": _test(F.contains),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "ENCODE_FOR_URI": _encode,
    "CONCAT": lambda *xs: Value("string", F.concat(F.lit(""), *(v.string(x) for x in xs))),
    "LANGMATCHES": _langmatches,
    "REGEX": _regex,
    "REPLACE": _replace,
    "ABS": _signed(F.abs),
    "ROUND": _rounded(lambda c: F.round(c, 0)),
    "CEIL": _rounded(F.ceil),
    "FLOOR": _rounded(F.floor),
    "RAND": lambda: Value("double", F.rand()),
    "NOW": lambda: Value("dateTime", F.current_timestamp()),
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.day),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": lambda x: Value("decimal", F.second(v.timestamp(x)).cast("double")),
    "TZ": lambda x: Value("string", _tz(x)),
    "TIMEZONE": _timezone,
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda c: F.sha2(c, 256)),
    "SHA384": _hash(lambda c: F.sha2(c, 384)),
    "SHA512": _hash(lambda c: F.sha2(c, 512)),
}
