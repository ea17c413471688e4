"""RDF/XML: a parser for whole documents and a serializer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from ternion import terms as t
from ternion.errors import RdfError
from ternion.terms import IRI, RDF, Blank, Literal, Term

Triple = tuple[Term, IRI, Term]
_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = f"{{{RDF}}}"
_NO_PROPERTY = {_R + x for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "Description", "RDF", "li")}


def _iri(tag: str) -> IRI:
    return IRI(tag[1:].replace("}", "", 1))


class _Document:
    def __init__(self, base: str):
        self.base, self.fresh, self.out = base, 0, []

    def blank(self) -> Blank:
        self.fresh += 1
        return Blank(f"genid{self.fresh}")

    def node(self, e: ET.Element, base: str, lang: str) -> Term:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if (about := e.get(_R + "about")) is not None:
            subject: Term = IRI(urljoin(base, about))
        elif (name := e.get(_R + "ID")) is not None:
            subject = IRI(urljoin(base, "#" + name))
        elif (name := e.get(_R + "nodeID")) is not None:
            subject = Blank(name)
        else:
            subject = self.blank()
        if e.tag != _R + "Description":
            self.out.append((subject, IRI(t.TYPE), _iri(e.tag)))
        self.attributes(subject, e, base, lang)
        items = 0
        for child in e:
            if child.tag == _R + "li":
                items += 1
                child.tag = f"{_R}_{items}"
            self.property(subject, child, base, lang)
        return subject

    def attributes(self, subject: Term, e: ET.Element, base: str, lang: str) -> None:
        for name, value in e.attrib.items():
            if name == _R + "type":
                self.out.append((subject, IRI(t.TYPE), IRI(urljoin(base, value))))
            elif name not in _NO_PROPERTY and not name.startswith(_XML) and name.startswith("{"):
                self.out.append((subject, _iri(name), Literal(value, t.LANG_STRING if lang else t.STRING, lang)))

    def property(self, subject: Term, e: ET.Element, base: str, lang: str) -> None:
        base, lang, p = e.get(_XML + "base", base), e.get(_XML + "lang", lang), _iri(e.tag)
        kind = e.get(_R + "parseType")
        if kind == "Resource":
            value: Term = self.blank()
            for child in e:
                self.property(value, child, base, lang)
        elif kind == "Collection":
            items = [self.node(child, base, lang) for child in e]
            value = IRI(RDF + "nil")
            for item in reversed(items):
                cell = self.blank()
                self.out += [(cell, IRI(RDF + "first"), item), (cell, IRI(RDF + "rest"), value)]
                value = cell
        elif kind == "Literal":
            value = Literal((e.text or "") + "".join(ET.tostring(c, "unicode") for c in e), RDF + "XMLLiteral")
        elif e.get(_R + "resource") is not None:
            value = IRI(urljoin(base, e.get(_R + "resource")))
            self.attributes(value, e, base, lang)
        elif e.get(_R + "nodeID") is not None:
            value = Blank(e.get(_R + "nodeID"))
        elif len(e):
            value = self.node(e[0], base, lang)
        elif e.get(_R + "datatype"):
            value = Literal(e.text or "", urljoin(base, e.get(_R + "datatype")))
        elif any(n.startswith("{") and n not in _NO_PROPERTY and not n.startswith(_XML) for n in e.attrib):
            value = self.blank()
            self.attributes(value, e, base, lang)
        else:
            value = Literal(e.text or "", t.LANG_STRING if lang else t.STRING, lang)
        self.out.append((subject, p, value))


def parse(text: str, base: str = "") -> Iterator[Triple]:
    """The triples of an RDF/XML document.  Document type definitions are refused."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise RdfError("document type definitions are not read")
    try:
        root = ET.fromstring(text.encode() if text.lstrip().startswith("<?xml") else text)
    except ET.ParseError as e:
        raise RdfError(f"no XML: {e}") from None
    doc = _Document(base)
    for e in root if root.tag == _R + "RDF" else [root]:
        doc.node(e, root.get(_XML + "base", base), root.get(_XML + "lang", ""))
    return iter(doc.out)


def _split(iri: str) -> tuple[str, str]:
    i = len(iri)
    while i and (iri[i - 1].isalnum() or iri[i - 1] in "_-."):
        i -= 1
    while i < len(iri) and not (iri[i].isalpha() or iri[i] == "_"):
        i += 1
    if i == len(iri):
        raise RdfError(f"<{iri}> can't be an element's name")
    return iri[:i], iri[i:]


def write(triples: Iterable[Triple]) -> str:
    rows = sorted(set(triples), key=lambda x: tuple(map(str, x)))
    spaces = {RDF: "rdf"}
    for _, p, _ in rows:
        spaces.setdefault(_split(p.value)[0], f"n{len(spaces)}")
    out = ['<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF' + "".join(f"\n  xmlns:{n}={quoteattr(s)}" for s, n in spaces.items()) + ">\n"]
    for s, p, o in rows:
        space, name = _split(p.value)
        tag = f"{spaces[space]}:{name}"
        who = f"rdf:about={quoteattr(s.value)}" if isinstance(s, IRI) else f"rdf:nodeID={quoteattr(s.label)}"
        if isinstance(o, IRI):
            body = f"<{tag} rdf:resource={quoteattr(o.value)}/>"
        elif isinstance(o, Blank):
            body = f"<{tag} rdf:nodeID={quoteattr(o.label)}/>"
        else:
            extra = f" xml:lang={quoteattr(o.language)}" if o.language else "" if o.datatype == t.STRING else f" rdf:datatype={quoteattr(o.datatype)}"
            body = f"<{tag}{extra}>{escape(o.lexical)}</{tag}>"
        out.append(f"  <rdf:Description {who}>{body}</rdf:Description>\n")
    return "".join(out) + "</rdf:RDF>\n"
