"""Turtle and TriG: a parser for whole documents and a serializer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

from ternion import terms as t
from ternion.errors import RdfError
from ternion.terms import IRI, RDF, Blank, Literal, Term

Triple = tuple[Term, IRI, Term]

_TOKENS = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\n\r]*)
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<string>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<keyword>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
    |(?P<decimal>[+-]?\d*\.\d+)
    |(?P<integer>[+-]?\d+)
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>\^\^|[{}()\[\].,;])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        code = m[1] or m[2]
        if not code and m[3] not in _PLAIN:
            raise RdfError(f"unknown escape \\{m[3]}")
        return chr(int(code, 16)) if code else _PLAIN[m[3]]

    return _ESCAPE.sub(one, text)


class _Document:
    def __init__(self, text: str, base: str, graphs: bool):
        self.text, self.base, self.graphs = text, base, graphs
        self.prefixes: dict[str, str] = {}
        self.at, self.fresh, self.out = 0, 0, []
        self.next()

    def fail(self, message: str) -> None:
        raise RdfError(f"{message} (line {self.text.count(chr(10), 0, self.start) + 1})")

    def next(self) -> None:
        while True:
            self.start = self.at
            if self.at >= len(self.text):
                self.kind, self.token = "end", ""
                return
            m = _TOKENS.match(self.text, self.at)
            if not m:
                self.fail(f"unexpected {self.text[self.at]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.token = m.lastgroup, m[0]
                return

    def take(self) -> str:
        token = self.token
        self.next()
        return token

    def eat(self, sign: str) -> bool:
        if self.kind == "sign" and self.token == sign:
            self.next()
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.eat(sign):
            self.fail(f"expected {sign}, found {self.token or 'the end'}")

    def iri(self) -> IRI:
        if self.kind == "iri":
            return IRI(t.resolved(self.base, _unescape(self.take()[1:-1])))
        if self.kind == "name":
            prefix, _, local = self.token.partition(":")
            if prefix not in self.prefixes:
                self.fail(f"unknown prefix {prefix}:")
            self.next()
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        self.fail(f"expected an IRI, found {self.token or 'the end'}")

    def blank(self) -> Blank:
        self.fresh += 1
        return Blank(f"genid{self.fresh}")

    def directive(self) -> bool:
        word = self.token.upper()
        if self.kind not in ("keyword", "word") or word not in ("@PREFIX", "@BASE", "PREFIX", "BASE"):
            return False
        self.next()
        if word.endswith("PREFIX"):
            if self.kind != "name" or not self.token.endswith(":"):
                self.fail("expected a prefix")
            prefix = self.take()[:-1]
            self.prefixes[prefix] = self.iri().value
        else:
            self.base = self.iri().value
        if word[0] == "@":
            self.need(".")
        return True

    def parse(self) -> Iterator[Triple]:
        while self.kind != "end":
            self.out = []
            if not self.directive():
                self.statement()
            yield from self.out

    def statement(self) -> None:
        if self.graphs:
            if self.kind == "word" and self.token.upper() == "GRAPH":
                self.next()
                self.block(self.subject())
                return
            if self.kind == "sign" and self.token == "{":
                self.block(None)
                return
        subject, simple = self.subject(True)
        if self.graphs and self.kind == "sign" and self.token == "{":
            self.block(subject)
            return
        if not (simple and self.kind == "sign" and self.token == "."):
            self.properties(subject)
        self.need(".")

    def block(self, name: Term | None) -> None:
        """A graph's triples; only the default graph's are kept."""
        self.need("{")
        held = self.out
        self.out = held if name is None else []
        while not self.eat("}"):
            subject, simple = self.subject(True)
            if not (simple and self.kind == "sign" and self.token in ".}"):
                self.properties(subject)
            if not self.eat(".") and not (self.kind == "sign" and self.token == "}"):
                self.fail(f"expected . or }}, found {self.token or 'the end'}")
        self.out = held

    def subject(self, tell: bool = False):
        bracket = self.kind == "sign" and self.token == "["
        node = self.object()
        if isinstance(node, Literal):
            self.fail("a literal can't be a subject")
        return (node, bracket) if tell else node

    def properties(self, subject: Term) -> None:
        while True:
            if self.kind == "word" and self.token == "a":
                self.next()
                p = IRI(t.TYPE)
            else:
                p = self.iri()
            while True:
                self.out.append((subject, p, self.object()))
                if not self.eat(","):
                    break
            if not self.eat(";"):
                return
            while self.eat(";"):
                pass
            if self.kind == "sign" and self.token in ".]}" or self.kind == "end":
                return

    def object(self) -> Term:
        kind = self.kind
        if kind in ("iri", "name"):
            return self.iri()
        if kind == "blank":
            return Blank(self.take()[2:])
        if kind == "string":
            token = self.take()
            n = 3 if token[:3] in ('"""', "'''") and len(token) >= 6 else 1
            text = _unescape(token[n:-n])
            if self.kind == "lang":
                return Literal(text, t.LANG_STRING, self.take()[1:])
            return Literal(text, self.iri().value) if self.eat("^^") else Literal(text)
        if kind in ("integer", "decimal", "double"):
            return Literal(self.take(), {"integer": t.INTEGER, "decimal": t.DECIMAL, "double": t.DOUBLE}[kind])
        if kind == "word" and self.token in ("true", "false"):
            return Literal(self.take(), t.BOOLEAN)
        if self.eat("["):
            node = self.blank()
            if not (self.kind == "sign" and self.token == "]"):
                self.properties(node)
            self.need("]")
            return node
        if self.eat("("):
            items = []
            while not self.eat(")"):
                items.append(self.object())
            head: Term = IRI(RDF + "nil")
            for item in reversed(items):
                cell = self.blank()
                self.out += [(cell, IRI(RDF + "first"), item), (cell, IRI(RDF + "rest"), head)]
                head = cell
            return head
        self.fail(f"unexpected {self.token or 'end'}")


def parse(text: str, base: str = "", graphs: bool = False) -> Iterator[Triple]:
    """The triples of a Turtle document, or with ``graphs`` of a TriG document's default graph."""
    return _Document(text, base, graphs).parse()


_LOCAL = re.compile(r"[^\W\d_][\w-]*|[\w][\w-]*")


def _shown(term: Term, prefixes: dict[str, str]) -> str:
    if isinstance(term, IRI):
        if term.value == t.TYPE:
            return "a"
        for name, space in prefixes.items():
            if term.value.startswith(space) and _LOCAL.fullmatch(term.value[len(space) :]):
                return f"{name}:{term.value[len(space):]}"
    if isinstance(term, Literal) and not term.language and term.datatype not in (t.STRING, t.LANG_STRING):
        bare = Literal(term.lexical)
        return f"{bare}^^{_shown(IRI(term.datatype), prefixes)}"
    return str(term)


def write(triples: Iterable[Triple], prefixes: dict[str, str] | None = None, graphs: bool = False) -> str:
    """A Turtle document, subjects and predicates in order; with ``graphs`` a TriG one."""
    prefixes = prefixes or {}
    out = [f"@prefix {n}: <{space}> .\n" for n, space in prefixes.items()]
    rows = sorted(set(triples), key=lambda x: tuple(map(str, x)))
    body = []
    for s, own in groupby(rows, key=lambda x: x[0]):
        parts = []
        for p, same in groupby(own, key=lambda x: x[1]):
            parts.append(f"{_shown(p, prefixes)} " + ", ".join(_object(o, prefixes) for _, _, o in same))
        body.append(f"{_object(s, prefixes)} " + " ;\n    ".join(parts) + " .\n")
    text = "".join(body)
    return "".join(out) + ("{\n" + text + "}\n" if graphs else text)


def _object(term: Term, prefixes: dict[str, str]) -> str:
    return f"<{t.TYPE}>" if isinstance(term, IRI) and term.value == t.TYPE else _shown(term, prefixes)
