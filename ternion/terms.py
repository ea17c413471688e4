"""RDF terms on the driver, and how a term looks as a column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

STRING, LANG_STRING = XSD + "string", RDF + "langString"
INTEGER, DECIMAL, FLOAT, DOUBLE = (XSD + t for t in ("integer", "decimal", "float", "double"))
BOOLEAN, DATE_TIME, DATE = (XSD + t for t in ("boolean", "dateTime", "date"))
TYPE = RDF + "type"

#: Numeric datatypes with their place in the promotion integer < decimal < float < double.
NUMERIC = {INTEGER: 0, DECIMAL: 1, FLOAT: 2, DOUBLE: 3} | {XSD + t: 0 for t in ("int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")}
BY_RANK = (INTEGER, DECIMAL, FLOAT, DOUBLE)

#: Kinds of terms in the order of ORDER BY; unbound comes before all.
BLANK, IRI_KIND, LITERAL = 0, 1, 2

#: A term as a column: kind, text (IRI, label or lexical form), datatype and language, never null inside.
TERM = "struct<k:int,v:string,dt:string,lang:string>"


@dataclass(frozen=True)
class IRI:
    value: str

    def __str__(self) -> str:
        return f"<{self.value}>"


@dataclass(frozen=True)
class Blank:
    label: str

    def __str__(self) -> str:
        return f"_:{self.label}"


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


@dataclass(frozen=True)
class Literal:
    lexical: str
    datatype: str = STRING
    language: str = ""

    def __str__(self) -> str:
        text = '"' + "".join(_ESCAPES.get(c, c) for c in self.lexical) + '"'
        return text + (f"@{self.language}" if self.language else "" if self.datatype == STRING else f"^^<{self.datatype}>")


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


Term = IRI | Blank | Literal


def resolved(base: str, iri: str) -> str:
    """An IRI reference in the context of a base IRI, if there is one."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
        return iri
    return urljoin(base, iri) + ("#" if iri.endswith("#") else "")


def canonical(term: Term) -> Term:
    """Integers, booleans and the like in the one form in which they are stored, so that equal values join."""
    if isinstance(term, Literal) and NUMERIC.get(term.datatype) == 0:
        try:
            return Literal(str(int(term.lexical)), term.datatype)
        except ValueError:
            return term
    if isinstance(term, Literal) and term.language:
        return Literal(term.lexical, LANG_STRING, term.language)
    return term


def row(term: Term) -> tuple[int, str, str, str]:
    """A term as the fields of TERM."""
    if isinstance(term, IRI):
        return IRI_KIND, term.value, "", ""
    if isinstance(term, Blank):
        return BLANK, term.label, "", ""
    return LITERAL, term.lexical, LANG_STRING if term.language else term.datatype, term.language


def of_row(k: int, v: str, dt: str, lang: str) -> Term:
    return IRI(v) if k == IRI_KIND else Blank(v) if k == BLANK else Literal(v, dt, lang)


def of_value(value: object) -> Term:
    """The term of a plain Python value; strings that look like web or URN addresses are IRIs."""
    if isinstance(value, IRI | Blank | Literal):
        return value
    if isinstance(value, bool):
        return Literal(str(value).lower(), BOOLEAN)
    if isinstance(value, int):
        return Literal(str(value), INTEGER)
    if isinstance(value, float):
        return Literal(repr(value), DOUBLE)
    text = str(value)
    return IRI(text) if text.startswith(("http://", "https://", "urn:")) else Literal(text)
