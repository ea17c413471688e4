"""N-Triples and N-Quads, read and written line by line on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.errors import RdfError
from ternion.plans.checkpoints import saved
from ternion.sources.store import COLUMNS

_IRI = r"<([^<>\"{}|^`\x00-\x20]*)>"
_BLANK = r"_:([\w][\w.\-]*)"
_LITERAL = r'"((?:[^"\\\n\r]|\\.)*)"(?:\^\^<([^<>\"{}|^`\x00-\x20]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?'
_LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:(?:{_IRI}|{_BLANK})\s*)?\.\s*(?:#.*)?$"


def unescaped(c: Column) -> Column:
    """Escapes of literals and IRIs undone; texts without a backslash are passed on as they are."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    code = lambda p: F.decode(F.unhex(F.lpad(F.substring(p, F.lit(3), F.lit(8)), 8, "0")), "UTF-32")
    one = lambda p: (
        F.when(~F.startswith(p, F.lit("\\")), p)
        .when(p.rlike(r"^\\[uU]"), code(p))
        .when(p == "\\t", "\t")
        .when(p == "\\n", "\n")
        .when(p == "\\r", "\r")
        .when(p == "\\b", "\b")
        .when(p == "\\f", "\f")
        .otherwise(F.substring(p, 2, 1))
    )
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def canonical_text(k: Column, v: Column, dt: Column) -> Column:
    """Integers in the one form in which they are stored."""
    whole = [name for name, rank in t.NUMERIC.items() if rank == 0]
    plain = F.regexp_replace(F.regexp_replace(v, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when((k == t.LITERAL) & dt.isin(whole) & v.rlike(r"^[+-]?\d+$"), F.when(plain == "-0", "0").otherwise(plain)).otherwise(v)


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Triples of a DataFrame of lines (column value).  Quads of named graphs are dropped.

    A column ``scope``, if there is one, goes before the names of blank nodes.

    strict: a line that is neither a statement, blank nor a comment is an error; else it is skipped.
    """
    at = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    scope = F.col("scope") if "scope" in lines.columns else F.lit("")
    at = at.select("value", scope.alias("scope"), F.col("value").rlike(_LINE).alias("ok"), *(part(i).alias(f"g{i}") for i in range(1, 11)))
    if strict:
        at = at.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("no N-Triples: "), F.substring("value", 1, 200))).cast("boolean")))
    at = at.filter("ok and g9 = '' and g10 = ''")
    literal = (F.col("g4") == "") & (F.col("g5") == "") & ~F.col("value").rlike(rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*<>")
    k = F.when(F.col("g5") != "", t.BLANK).when(literal, t.LITERAL).otherwise(t.IRI_KIND)
    dt = F.when(literal, F.when(F.col("g8") != "", t.LANG_STRING).when(F.col("g7") != "", F.col("g7")).otherwise(t.STRING)).otherwise("")
    text = F.when(k == t.BLANK, F.concat("scope", "g5")).when(literal, unescaped(F.col("g6"))).otherwise(unescaped(F.col("g4")))
    out = at.select(
        F.when(F.col("g2") != "", t.BLANK).otherwise(t.IRI_KIND).alias("sk"), F.when(F.col("g2") != "", F.concat("scope", "g2")).otherwise(unescaped(F.col("g1"))).alias("s"), unescaped(F.col("g3")).alias("p"), k.alias("k"), text.alias("v"), dt.alias("dt"), F.when(literal, F.col("g8")).otherwise("").alias("lang")
    )
    return out.withColumn("v", canonical_text(F.col("k"), F.col("v"), F.col("dt")))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The distinct triples of files of N-Triples or N-Quads, compressed or not, however large."""
    try:
        # the parts of one write have one name but for their numbers
        scope = F.concat(F.lit("f"), F.md5(F.regexp_replace("_metadata.file_path", r"part-\d+", "part")))
        return saved(parse(spark.read.text(path).select("value", scope.alias("scope")), strict).dropDuplicates(COLUMNS), "loaded")
    except Exception as e:
        if "no N-Triples" in str(e):
            raise RdfError(str(e)[str(e).index("no N-Triples") :].splitlines()[0]) from None
        raise


def _escaped(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line for each triple, in column value."""
    s = F.when(F.col("sk") == t.BLANK, F.concat(F.lit("_:"), "s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    tail = F.when(F.col("lang") != "", F.concat(F.lit("@"), "lang")).when(F.col("dt") != t.STRING, F.concat(F.lit("^^<"), "dt", F.lit(">"))).otherwise("")
    o = F.when(F.col("k") == t.BLANK, F.concat(F.lit("_:"), "v")).when(F.col("k") == t.IRI_KIND, F.concat(F.lit("<"), "v", F.lit(">"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("v")), F.lit('"'), tail))
    return triples.select(F.concat(s, F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))
