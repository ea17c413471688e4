"""Loading and exporting files by format."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternion.errors import LoadError, RdfError
from ternion.plans.checkpoints import saved
from ternion.sources import jsonld, ntriples, rdfxml, turtle
from ternion.sources.store import COLUMNS, SCHEMA, as_row
from ternion.terms import IRI, Term, of_row

#: Formats by file extension.
EXTENSIONS = {".nt": "ntriples", ".ntriples": "ntriples", ".nq": "nquads", ".ttl": "turtle", ".turtle": "turtle", ".trig": "trig", ".rdf": "rdfxml", ".xml": "rdfxml", ".owl": "rdfxml", ".jsonld": "jsonld", ".json": "jsonld"}
#: Bytes up to which a file that must be parsed whole is read.
MOST_BYTES = 100 << 20

_PARSERS: dict[str, Callable[[str, str], Iterator]] = {
    "turtle": turtle.parse,
    "trig": lambda text, base: turtle.parse(text, base, True),
    "rdfxml": rdfxml.parse,
    "jsonld": jsonld.parse,
}


def format_of(path: str, given: str | None = None) -> str:
    if given:
        if given not in {*EXTENSIONS.values()}:
            raise LoadError(f"unknown format {given}")
        return given
    name = PurePosixPath(path)
    suffix = name.with_suffix("").suffix if name.suffix in (".gz", ".bz2") else name.suffix
    if suffix.lower() not in EXTENSIONS:
        raise LoadError(f"no format for {path}")
    return EXTENSIONS[suffix.lower()]


def parse_text(text: str, kind: str, base: str = "") -> Iterator[tuple[Term, IRI, Term]]:
    """Triples of a document in memory.  N-Triples are Turtle; N-Quads are read by parse_frame."""
    return _PARSERS["turtle" if kind == "ntriples" else kind](text, base)


def from_text(spark: SparkSession, text: str, kind: str, base: str = "") -> DataFrame:
    if kind == "nquads":
        return ntriples.parse(spark.createDataFrame([(x,) for x in text.splitlines()], "value string")).dropDuplicates(COLUMNS)
    return spark.createDataFrame([as_row(*x) for x in parse_text(text, kind, base)], SCHEMA).dropDuplicates(COLUMNS)


def load(spark: SparkSession, path: str, kind: str | None = None, base: str = "", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The distinct triples of a file, folder or glob, read through Spark.

    N-Triples and N-Quads are read line by line and may have any size.  A file of another format is
    one document: it is parsed whole by one task, many files by many, and must not be larger than
    ``most_bytes``.  Blank nodes of different files are kept apart, but for
    the parts that Spark has written of one graph.
    """
    if ".." in PurePosixPath(path).parts:
        raise LoadError("a path must not go upward")
    kind = format_of(path, kind)
    if kind in ("ntriples", "nquads"):
        return ntriples.read(spark, path)
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(F.col("length") > most_bytes).select("path").limit(1).collect()
    if large:
        raise LoadError(f"{large[0].path} has more than {most_bytes} bytes")
    parser = _PARSERS[kind]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                tag = f"f{hashlib.md5(name.encode()).hexdigest()}"
                rows = [as_row(*x) for x in parser(bytes(content).decode(), base or name)]
                made = pd.DataFrame(rows, columns=COLUMNS)
                for kind_column, column in (("sk", "s"), ("k", "v")):
                    mask = made[kind_column] == 0
                    made.loc[mask, column] = tag + made.loc[mask, column]
                yield made

    try:
        return saved(files.select("path", "content").mapInPandas(run, SCHEMA).dropDuplicates(COLUMNS), "loaded")
    except Exception as e:
        if "RdfError" in str(e):
            raise RdfError(str(e).split("RdfError:")[-1].strip().splitlines()[0]) from None
        raise


def collected(triples: DataFrame) -> Iterator[tuple[Term, IRI, Term]]:
    """Triples one by one on the driver."""
    for r in triples.select(*COLUMNS).toLocalIterator():
        yield of_row(r.sk, r.s, "", ""), IRI(r.p), of_row(r.k, r.v, r.dt, r.lang)


def to_text(triples: DataFrame, kind: str, prefixes: dict[str, str] | None = None) -> str:
    if kind in ("ntriples", "nquads"):
        return "".join(r.value + "\n" for r in ntriples.lines(triples).orderBy("value").toLocalIterator())
    rows = collected(triples)
    if kind == "rdfxml":
        return rdfxml.write(rows)
    return jsonld.write(rows) if kind == "jsonld" else turtle.write(rows, prefixes, kind == "trig")


def export(triples: DataFrame, path: str, kind: str | None = None, prefixes: dict[str, str] | None = None) -> int:
    """Writes triples and returns how many.

    N-Triples and N-Quads become a folder of part files, written by the executors.  A document of
    another format is put together on the driver and suits graphs that fit there.
    """
    kind = format_of(path, kind)
    if kind in ("ntriples", "nquads"):
        ntriples.lines(triples).write.mode("overwrite").text(path)
        return triples.count()
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_text(triples, kind, prefixes))
    return triples.count()
