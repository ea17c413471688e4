"""The SPARQL algebra and expressions as plain trees, with helpers to walk them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace

from ternion.terms import Term, Var

# Expressions


@dataclass(frozen=True)
class Ref:
    """A variable in an expression."""

    name: str


@dataclass(frozen=True)
class Const:
    term: Term


@dataclass(frozen=True)
class Call:
    """An operator or function: a symbol, an upper-case name, or an IRI."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object = None  # None: all solutions
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


Expression = Ref | Const | Call | Aggregate | Exists

# Property paths


@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    left: object
    right: object


@dataclass(frozen=True)
class Alternative:
    left: object
    right: object


@dataclass(frozen=True)
class Repeat:
    """``least`` 0 or 1 steps at least; many: any number, else one step at most."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class Negated:
    """Any predicate but these, forward; and backward any but those, if ``inverse`` is not None."""

    forward: tuple[str, ...]
    inverse: tuple[str, ...] | None = None
    ahead: bool = True


# Patterns


@dataclass(frozen=True)
class Triple:
    s: Term | Var
    p: Term | Var
    o: Term | Var


@dataclass(frozen=True)
class BGP:
    triples: tuple[Triple, ...] = ()


@dataclass(frozen=True)
class Path:
    s: Term | Var
    path: object
    o: Term | Var


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass(frozen=True)
class Filter:
    condition: object
    child: object


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Extend:
    child: object
    name: str
    value: object


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple, ...]  # None: undefined


@dataclass(frozen=True)
class Empty:
    """No solutions."""

    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Graph:
    name: Term | Var
    child: object


@dataclass(frozen=True)
class Service:
    name: Term | Var
    child: object
    silent: bool = False


@dataclass(frozen=True)
class Group:
    child: object
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass(frozen=True)
class Project:
    child: object
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    child: object


@dataclass(frozen=True)
class Reduced:
    child: object


@dataclass(frozen=True)
class OrderBy:
    child: object
    keys: tuple[tuple[object, bool], ...]  # expression, ascending


@dataclass(frozen=True)
class Slice:
    child: object
    offset: int = 0
    limit: int | None = None


# Queries and updates


@dataclass(frozen=True)
class Query:
    form: str  # SELECT, ASK, CONSTRUCT or DESCRIBE
    pattern: object
    names: tuple[str, ...] = ()
    template: tuple[Triple, ...] = ()
    targets: tuple = ()  # of DESCRIBE: IRIs and variables


@dataclass(frozen=True)
class Modify:
    """DELETE and INSERT templates; without a pattern they are data."""

    delete: tuple[Triple, ...] = ()
    insert: tuple[Triple, ...] = ()
    pattern: object = None


@dataclass(frozen=True)
class Clear:
    target: str  # DEFAULT, NAMED, ALL or an IRI
    drop: bool = False


@dataclass(frozen=True)
class Create:
    graph: str


@dataclass(frozen=True)
class Load:
    source: str
    silent: bool = False


@dataclass(frozen=True)
class Update:
    operations: tuple = ()
    prefixes: dict = field(default_factory=dict)


_NODES = (BGP, Path, Join, LeftJoin, Filter, Union, Minus, Extend, Values, Empty, Graph, Service, Group, Project, Distinct, Reduced, OrderBy, Slice)


def children(node: object) -> list:
    """The patterns right below a pattern."""
    return [v for f in fields(node) if isinstance(v := getattr(node, f.name), _NODES)]


def rebuilt(node: object, change: Callable[[object], object]) -> object:
    """The node with each pattern right below it changed."""
    new = {f.name: change(v) for f in fields(node) if isinstance(v := getattr(node, f.name), _NODES)}
    return replace(node, **new) if new else node


def walk(node: object) -> Iterator[object]:
    yield node
    for child in children(node):
        yield from walk(child)


def depth(node: object) -> int:
    return 1 + max((depth(c) for c in children(node)), default=0)


def term_names(term: object) -> set[str]:
    from ternion.terms import Blank

    return {term.name} if isinstance(term, Var) else {blank_name(term)} if isinstance(term, Blank) else set()


def blank_name(term) -> str:
    """The hidden variable that a blank node of a pattern stands for."""
    return f"_b_{term.label}"


def in_scope(node: object) -> set[str]:
    """Variables (and hidden ones of blank nodes) that a pattern may bind."""
    if isinstance(node, BGP):
        return {n for t in node.triples for x in (t.s, t.p, t.o) for n in term_names(x)}
    if isinstance(node, Path):
        return term_names(node.s) | term_names(node.o)
    if isinstance(node, Values | Empty):
        return set(node.names)
    if isinstance(node, Project):
        return set(node.names)
    if isinstance(node, Group):
        return {*node.keys, *(n for n, _ in node.aggregates)}
    if isinstance(node, Minus):
        return in_scope(node.left)
    names = set().union(*(in_scope(c) for c in children(node)))
    if isinstance(node, Extend):
        names.add(node.name)
    if isinstance(node, Graph | Service):
        names |= term_names(node.name)
    return names


def bound(node: object) -> set[str]:
    """Variables that every solution of a pattern binds."""
    if isinstance(node, BGP | Path):
        return in_scope(node)
    if isinstance(node, Values):
        return {n for i, n in enumerate(node.names) if all(r[i] is not None for r in node.rows)}
    if isinstance(node, LeftJoin | Minus):
        return bound(node.left)
    if isinstance(node, Join):
        return bound(node.left) | bound(node.right)
    if isinstance(node, Union):
        return bound(node.left) & bound(node.right)
    if isinstance(node, Project):
        return bound(node.child) & set(node.names)
    if isinstance(node, Group):
        return bound(node.child) & set(node.keys)
    return bound(node.child) if hasattr(node, "child") else set()


def references(e: object) -> set[str]:
    """Variables that an expression mentions, inside EXISTS too."""
    if isinstance(e, Ref):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*(references(a) for a in e.args))
    if isinstance(e, Aggregate):
        return references(e.arg) if e.arg is not None else set()
    if isinstance(e, Exists):
        return in_scope(e.pattern)
    return set()


def has_exists(e: object) -> bool:
    return isinstance(e, Exists) or isinstance(e, Call) and any(has_exists(a) for a in e.args)


def conjuncts(e: object) -> list:
    return [c for a in e.args for c in conjuncts(a)] if isinstance(e, Call) and e.op == "&&" else [e]


def show(node: object, indent: int = 0) -> str:
    """A pattern as indented text."""
    pad = "  " * indent
    flat = {f.name: getattr(node, f.name) for f in fields(node) if not isinstance(getattr(node, f.name), _NODES)}
    line = f"{pad}{type(node).__name__}" + "".join(f" {k}={v!r}" for k, v in flat.items() if v not in ((), None))
    return "\n".join([line, *(show(c, indent + 1) for c in children(node))])
