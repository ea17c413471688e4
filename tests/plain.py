"""A plain evaluator of the algebra over Python tuples, by nested loops, to test the engine against."""

from __future__ import annotations

from ternion.plans import algebra as a
from ternion.terms import NUMERIC, Blank, Literal, Var, canonical


def name(x):
    return x.name if isinstance(x, Var) else a.blank_name(x) if isinstance(x, Blank) else None


def extend(row, pairs):
    row = dict(row)
    for x, value in pairs:
        n = name(x)
        if n is None:
            if canonical(x) != value:
                return None
        elif row.setdefault(n, value) != value:
            return None
    return row


def compatible(x, y):
    return all(y[n] == v for n, v in x.items() if n in y)


def pairs(graph, p):
    """The (s, o) of a path, as a list with duplicates where the path keeps them."""
    if isinstance(p, a.Link):
        return [(s, o) for s, q, o in graph if q.value == p.iri]
    if isinstance(p, a.Inverse):
        return [(o, s) for s, o in pairs(graph, p.path)]
    if isinstance(p, a.Sequence):
        return [(s, o) for s, m in pairs(graph, p.left) for n, o in pairs(graph, p.right) if m == n]
    if isinstance(p, a.Alternative):
        return pairs(graph, p.left) + pairs(graph, p.right)
    if isinstance(p, a.Negated):
        out = [(s, o) for s, q, o in graph if q.value not in p.forward] if p.ahead else []
        return out + ([(o, s) for s, q, o in graph if q.value not in p.inverse] if p.inverse is not None else [])
    steps = set(pairs(graph, p.path))
    found = set(steps)
    while p.many:
        more = {(s, o) for s, m in found for n, o in steps if m == n} - found
        if not more:
            break
        found |= more
    if p.least == 0:
        found |= {(x, x) for s, _, o in graph for x in (s, o)}
    return list(found)


def number(term):
    if isinstance(term, Literal) and term.datatype in NUMERIC:
        try:
            return float(term.lexical)
        except ValueError:
            return None
    return None


def value(e, row, graph):
    """A filter's value: True, False, a number or a term; None is an error."""
    if isinstance(e, a.Ref):
        return row.get(e.name)
    if isinstance(e, a.Const):
        return canonical(e.term)
    if isinstance(e, a.Exists):
        found = any(compatible(row, r) for r in solve(e.pattern, graph, row))
        return found != e.negated
    if e.op == "BOUND":
        return e.args[0].name in row
    args = [value(x, row, graph) for x in e.args]
    if e.op == "!":
        return None if args[0] is None else not args[0]
    if e.op == "&&":
        return False if False in args else None if None in args else True
    if e.op == "||":
        return True if True in args else None if None in args else False
    if None in args:
        return None
    x, y = args
    m, n = number(x), number(y)
    if e.op in ("=", "!="):
        same = m == n if m is not None and n is not None else x == y
        return same == (e.op == "=")
    if m is None or n is None:
        return None
    return {"<": m < n, ">": m > n, "<=": m <= n, ">=": m >= n}[e.op]


def solve(node, graph, fixed=None):
    """Solutions as a list of dicts; an unbound variable is absent.  fixed: values that stand for variables, of the row around an EXISTS."""
    fixed = fixed or {}
    inside = lambda n: solve(n, graph, fixed)
    known = lambda *terms: {n: fixed[n] for n in map(name, terms) if n in fixed}
    if isinstance(node, a.BGP):
        rows = [{}]
        for t in node.triples:
            rows = [r for row in rows for s, p, o in graph if (r := extend(row | known(t.s, t.p, t.o), ((t.s, s), (t.p, p), (t.o, o)))) is not None]
        return rows
    if isinstance(node, a.Path):
        found = pairs(graph, node.path)
        for end in (node.s, node.o):
            if name(end) is None and isinstance(node.path, a.Repeat) and node.path.least == 0 and (end, end) not in found:
                found.append((end, end))
        return [r for s, o in found if (r := extend(known(node.s, node.o), ((node.s, s), (node.o, o)))) is not None]
    if isinstance(node, a.Join):
        right = inside(node.right)
        return [x | y for x in inside(node.left) for y in right if compatible(x, y)]
    if isinstance(node, a.LeftJoin):
        right, out = inside(node.right), []
        for x in inside(node.left):
            met = [x | y for y in right if compatible(x, y)]
            if node.condition is not None:
                met = [r for r in met if value(node.condition, r | fixed, graph) is True]
            out += met or [x]
        return out
    if isinstance(node, a.Filter):
        return [r for r in inside(node.child) if value(node.condition, r | fixed, graph) is True]
    if isinstance(node, a.Union):
        return inside(node.left) + inside(node.right)
    if isinstance(node, a.Minus):
        right = inside(node.right)
        return [x for x in inside(node.left) if not any(compatible(x, y) and (x.keys() & y.keys()) - fixed.keys() for y in right)]
    if isinstance(node, a.Values):
        rows = [{n: canonical(v) for n, v in zip(node.names, r) if v is not None} for r in node.rows]
        return [r for r in rows if compatible(r, fixed)]
    if isinstance(node, a.Project):
        return [{n: r[n] for n in node.names if n in r} for r in solve(node.child, graph)]
    if isinstance(node, a.Distinct | a.Reduced):
        seen = {}
        for r in inside(node.child):
            seen[frozenset(r.items())] = r
        return list(seen.values())
    raise NotImplementedError(type(node).__name__)
