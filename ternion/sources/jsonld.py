"""JSON-LD with inline contexts: a parser for whole documents and a serializer."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

from ternion import terms as t
from ternion.errors import RdfError
from ternion.terms import IRI, RDF, Blank, Literal, Term

Triple = tuple[Term, IRI, Term]


class _Document:
    def __init__(self, base: str):
        self.base, self.fresh, self.out = base, 0, []

    def blank(self) -> Blank:
        self.fresh += 1
        return Blank(f"genid{self.fresh}")

    def context(self, old: dict, new: object) -> dict:
        if isinstance(new, list):
            for x in new:
                old = self.context(old, x)
            return old
        if new is None:
            return {}
        if isinstance(new, str):
            raise RdfError("remote contexts are not fetched")
        return old | new

    def expand(self, name: str, ctx: dict, vocab: bool = True) -> str | None:
        if name.startswith("@"):
            return name
        if vocab and name in ctx:
            own = ctx[name].get("@id", name) if isinstance(ctx[name], dict) else ctx[name]
            return None if own is None else self.expand(own, {k: v for k, v in ctx.items() if k != name})
        prefix, colon, rest = name.partition(":")
        if colon:
            if prefix == "_" or rest.startswith("//"):
                return name
            space = ctx.get(prefix)
            space = space.get("@id") if isinstance(space, dict) else space
            return space + rest if space else name
        if vocab:
            return ctx["@vocab"] + name if ctx.get("@vocab") else None
        return urljoin(ctx.get("@base") or self.base, name)

    def ref(self, name: str, ctx: dict, vocab: bool = False) -> Term:
        full = self.expand(name, ctx, vocab) or urljoin(self.base, name)
        return Blank(full[2:]) if full.startswith("_:") else IRI(full)

    def node(self, x: dict, ctx: dict) -> Term:
        ctx = self.context(ctx, x["@context"]) if "@context" in x else ctx
        keys = {k: self.expand(k, ctx) for k in x}
        by = {full: k for k, full in keys.items() if full and full.startswith("@")}
        subject = self.ref(x[by["@id"]], ctx) if "@id" in by else self.blank()
        for k, full in keys.items():
            if full == "@type":
                for name in x[k] if isinstance(x[k], list) else [x[k]]:
                    self.out.append((subject, IRI(t.TYPE), self.ref(name, ctx, True)))
            elif full == "@graph":
                for inner in x[k]:
                    self.node(inner, ctx)
            elif full == "@reverse":
                for name, values in x[k].items():
                    p = IRI(self.expand(name, ctx))
                    for value in values if isinstance(values, list) else [values]:
                        self.out.append((self.value(value, ctx, {}), p, subject))
            elif full and not full.startswith("@"):
                spec = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
                values = x[k]
                if isinstance(values, dict) and spec.get("@container") == "@language":
                    for lang, texts in values.items():
                        for text in texts if isinstance(texts, list) else [texts]:
                            self.out.append((subject, IRI(full), Literal(text, t.LANG_STRING, lang)))
                    continue
                if isinstance(values, list) and spec.get("@container") == "@list":
                    values = {"@list": values}
                for value in values if isinstance(values, list) else [values]:
                    if value is not None:
                        self.out.append((subject, IRI(full), self.value(value, ctx, spec)))
        return subject

    def value(self, x: object, ctx: dict, spec: dict) -> Term:
        if isinstance(x, dict):
            if "@value" in x:
                if lang := x.get("@language"):
                    return Literal(str(x["@value"]), t.LANG_STRING, lang)
                kind = x.get("@type")
                return Literal(self.text(x["@value"]), self.expand(kind, ctx)) if kind else self.value(x["@value"], {}, {})
            if "@list" in x:
                items = [self.value(v, ctx, spec) for v in x["@list"]]
                head: Term = IRI(RDF + "nil")
                for item in reversed(items):
                    cell = self.blank()
                    self.out += [(cell, IRI(RDF + "first"), item), (cell, IRI(RDF + "rest"), head)]
                    head = cell
                return head
            if "@set" in x:
                raise RdfError("@set inside a value")
            return self.node(x, ctx)
        kind = spec.get("@type")
        if kind in ("@id", "@vocab"):
            return self.ref(x, ctx, kind == "@vocab")
        if isinstance(x, bool):
            return Literal(self.text(x), self.expand(kind, ctx) if kind else t.BOOLEAN)
        if isinstance(x, int) or isinstance(x, float) and x.is_integer() and abs(x) < 1e21 and not kind:
            return Literal(str(int(x)), self.expand(kind, ctx) if kind else t.INTEGER)
        if isinstance(x, float):
            return Literal(self.text(x), self.expand(kind, ctx) if kind else t.DOUBLE)
        lang = spec.get("@language", ctx.get("@language"))
        return Literal(x, self.expand(kind, ctx)) if kind else Literal(x, t.LANG_STRING, lang) if lang else Literal(x)

    @staticmethod
    def text(x: object) -> str:
        return str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, float) else str(x)


def parse(text: str, base: str = "") -> Iterator[Triple]:
    """The triples of a JSON-LD document's default graph; contexts must be inline."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise RdfError(f"no JSON: {e}") from None
    doc = _Document(base)
    for x in data if isinstance(data, list) else [data]:
        if set(x) - {"@context"} == {"@graph"}:
            ctx = doc.context({}, x.get("@context", {}))
            for inner in x["@graph"] if isinstance(x["@graph"], list) else [x["@graph"]]:
                doc.node(inner, ctx)
        else:
            doc.node(x, {})
    return iter(doc.out)


def write(triples: Iterable[Triple]) -> str:
    nodes: dict[str, dict] = {}
    name = lambda x: x.value if isinstance(x, IRI) else f"_:{x.label}"
    for s, p, o in sorted(set(triples), key=lambda x: tuple(map(str, x))):
        node = nodes.setdefault(name(s), {"@id": name(s)})
        if p.value == t.TYPE and isinstance(o, IRI):
            node.setdefault("@type", []).append(o.value)
        elif isinstance(o, Literal):
            kind = {"@language": o.language} if o.language else {} if o.datatype == t.STRING else {"@type": o.datatype}
            node.setdefault(p.value, []).append({"@value": o.lexical} | kind)
        else:
            node.setdefault(p.value, []).append({"@id": name(o)})
    return json.dumps(list(nodes.values()), ensure_ascii=False, indent=1) + "\n"
