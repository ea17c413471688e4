"""Algebra to DataFrames."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternion.errors import UnsupportedError
from ternion.functions import aggregates
from ternion.functions import values as v
from ternion.functions.scalar import Registry, condition, evaluate
from ternion.operators import joins
from ternion.operators.paths import path
from ternion.plans import algebra as a
from ternion.plans.dataset import Dataset
from ternion.plans.solution import SPARK_TYPES, Info, Solution
from ternion.terms import IRI, Blank, Var, canonical, row

_marks = count()


class Planner:
    """Builds the DataFrame of a pattern over a dataset.  Nothing runs but what repeated paths need."""

    def __init__(self, data: Dataset, functions: Registry | None = None):
        self.data, self.functions = data, functions or {}
        self.mentions: Counter[str] = Counter()
        self.seed: Solution | None = None  # values of outer variables, while a pattern of EXISTS is solved for each of them

    def plan(self, node: object, outer: set[str] | None = None) -> Solution:
        """outer: variables that are needed besides those the pattern mentions."""
        self.mentions = Counter(_mentions(node))
        self.mentions.update(outer or ())
        return self.solve(node)

    def solve(self, node: object) -> Solution:
        if self.seed is not None and isinstance(node, _LEAVES):
            return joins.join(self._under(None, node), self.seed)
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def _under(self, seed: Solution | None, node: object) -> Solution:
        before, self.seed = self.seed, seed
        try:
            return self.solve(node)
        finally:
            self.seed = before

    def _one(self) -> Solution:
        return Solution(self.data.spark.range(1).select(F.lit(1).alias("_one")), {})

    def _beside(self, node: object) -> Solution:
        """The right part of OPTIONAL or MINUS, whose left one has the outer values: joined to them also here, a pattern that shares no variable with them would be a product."""
        if self.seed is not None and not _beyond(node, set(self.seed.infos)):
            return self._under(None, node)
        return self.solve(node)

    # patterns

    def _bgp(self, node: a.BGP) -> Solution:
        if not node.triples:
            return self._one()
        units = self.data.units(node.triples, self.mentions)
        units.sort(key=lambda u: u[0])
        _, out, keys = units.pop(0)
        while units:
            # the smallest of those that meet in a key of either side, where no row is multiplied on both;
            # then of those that share another variable, so that products come last
            shared = [u[1].infos.keys() & out.infos.keys() for u in units]
            i = next((i for i, u in enumerate(units) if shared[i] & (keys | u[2])), None)
            if i is None:
                i = next((i for i, x in enumerate(shared) if x), 0)
            _, unit, own = units.pop(i)
            keys = (keys if shared[i] & own else set()) | (own if shared[i] & keys else set())
            out = joins.join(out, unit)
        return out

    def _path(self, node: a.Path) -> Solution:
        return path(self.data, node.s, node.path, node.o)

    def _join(self, node: a.Join) -> Solution:
        left, right = (node.right, node.left) if isinstance(node.left, _LEAVES) else (node.left, node.right)
        # one side with the outer values is enough where the other can't use them
        return joins.join(self.solve(left), self._under(None, right) if isinstance(right, _LEAVES) else self.solve(right))

    def _leftjoin(self, node: a.LeftJoin) -> Solution:
        left, right = self.solve(node.left), self._beside(node.right)
        if node.condition is None:
            return joins.left_join(left, right)
        if a.has_exists(node.condition):
            held, names = joins.kept_apart(left)
            both = self._where(joins.join(held, right), node.condition)
            rest = joins.without(left, both, names)
            return joins.union(both.only([n for n in both.infos if n not in names.values()]), rest)
        return joins.left_join(left, right, lambda scope: condition(node.condition, scope, self.functions))

    def _filter(self, node: a.Filter) -> Solution:
        return self._where(self.solve(node.child), node.condition)

    def _where(self, out: Solution, test: object) -> Solution:
        plain, later = [], []
        for c in a.conjuncts(test):
            negated, inner = False, c
            while isinstance(inner, a.Call) and inner.op == "!" and a.has_exists(inner):
                negated, inner = not negated, inner.args[0]
            if isinstance(inner, a.Exists):
                later.append((inner.pattern, inner.negated != negated))
            else:
                plain.append(c)
        for c in plain:
            out = self._kept(out, c)
        for pattern, anti in later:
            out = self._exists(out, pattern, anti)
        return out

    def _kept(self, out: Solution, c: object) -> Solution:
        if not a.has_exists(c):
            return out.filter(condition(c, out.scope, self.functions))
        names = list(out.infos)

        def marked(e: object) -> object:
            nonlocal out
            if isinstance(e, a.Exists):
                name = f"_mark{next(_marks)}"
                out = self._marked(out, e.pattern, name)
                return a.Call("!", (a.Ref(name),)) if e.negated else a.Ref(name)
            return a.Call(e.op, tuple(marked(x) for x in e.args)) if isinstance(e, a.Call) else e

        c = marked(c)
        return out.filter(condition(c, out.scope, self.functions)).only(names)

    def _marked(self, left: Solution, pattern: object, name: str) -> Solution:
        """Left rows with a boolean column telling whether EXISTS holds."""
        if not _beyond(pattern, set(left.infos)):
            right = self._under(None, pattern)
            if not any(left.infos[n].nullable or i.nullable for n, i in right.infos.items() if n in left.infos):
                return joins.marked(left, right, name)
        used = set(_mentions(pattern))
        names = [n for n in left.infos if n in used]
        keys = left.only(names)
        return joins.marked_by(left, self._exists(Solution(keys.df.distinct(), keys.infos), pattern, False), names, name)

    def _exists(self, left: Solution, pattern: object, anti: bool) -> Solution:
        """A semi or anti join.

        An outer row's values stand for its variables everywhere in the pattern.  Mostly a join with
        the pattern's solutions tells the same.  Where it doesn't (a nested filter or BIND mentions
        an outer variable, or only the optional or subtracted part has it), UNION is taken apart and
        filters move up into the join's condition; what is left is solved together with the
        different values of those variables.
        """
        outer = set(left.infos)
        need = _beyond(pattern, outer)
        if not need:
            return joins.semi_join(left, self._under(None, pattern), anti)
        for n in sorted(need):
            if left.infos[n].nullable:  # an unbound variable stands for itself
                return reduce(joins.union, (self._exists(part, pattern, anti) for part in joins.split(left, n)))
        branches = _branches(pattern)
        if len(branches) > 1:
            found, rest = [], left
            for b in branches:
                if not anti:
                    found.append(self._exists(rest, b, False))
                if anti or b is not branches[-1]:
                    rest = self._exists(rest, b, True)
            return rest if anti else reduce(joins.union, found)
        pattern, lifted = _pulled(pattern, outer)
        need = _beyond(pattern, outer)
        if need:  # with the other values that rows always have, so that this is a hash join
            need |= {n for n in _mentions(pattern) if n in outer and not left.infos[n].nullable} - _assigned(pattern)
        seed = left.only(sorted(need)) if need else None
        right = self._under(seed and Solution(seed.df.distinct(), seed.infos), pattern)
        test = None
        if lifted:

            def test(both: dict) -> Column:
                return reduce(lambda x, y: x & y, (condition(c, both, self.functions) for c in lifted))

        return joins.semi_join(left, right, anti, test)

    def _union(self, node: a.Union) -> Solution:
        return joins.union(self.solve(node.left), self.solve(node.right))

    def _minus(self, node: a.Minus) -> Solution:
        return joins.minus(self.solve(node.left), self._beside(node.right), set(self.seed.infos) if self.seed else set())

    def _extend(self, node: a.Extend) -> Solution:
        out = self.solve(node.child)
        if self.seed is not None and node.name in self.seed.infos:
            raise UnsupportedError("BIND to a variable of the outer pattern in EXISTS")
        return out.with_value(node.name, evaluate(node.value, out.scope, self.functions))

    def _values(self, node: a.Values) -> Solution:
        if not node.names:
            return Solution(self.data.spark.range(len(node.rows)).select(F.lit(1).alias("_one")), {})
        infos, columns = {}, []
        for i, name in enumerate(node.names):
            terms = [r[i] for r in node.rows]
            kinds = {v.constant(x).kind for x in terms if x is not None}
            kind = kinds.pop() if len(kinds) == 1 else "term" if kinds else "unbound"
            if kind in ("dateTime", "date", "decimal", "double", "boolean"):
                kind = "term"
            infos[name] = Info(kind, None, None in terms)
            columns.append([None if x is None else _native(x, kind) for x in terms])
        schema = ", ".join(f"`{n}` {SPARK_TYPES[i.kind]}" for n, i in infos.items())
        return Solution(self.data.spark.createDataFrame(list(zip(*columns, strict=True)), schema), infos)

    def _empty(self, node: a.Empty) -> Solution:
        return self.data.nothing(list(node.names))

    def _graph(self, node: a.Graph) -> Solution:
        # only the default graph holds triples
        return self.data.nothing(sorted(a.in_scope(node)))

    def _service(self, node: a.Service) -> Solution:
        if node.silent:
            return self._one()
        raise UnsupportedError("SERVICE: there is no federation")

    # modifiers

    def _project(self, node: a.Project) -> Solution:
        out = self.solve(node.child)
        missing = [n for n in node.names if n not in out.infos]
        for n in missing:
            out = out.with_value(n, v.null())
        return out.only(list(node.names))

    def _distinct(self, node: a.Distinct) -> Solution:
        out = self.solve(node.child)
        return Solution(out.df.distinct(), out.infos)

    _reduced = _distinct

    def _orderby(self, node: a.OrderBy) -> Solution:
        out = self.solve(node.child)
        keys = []
        for e, ascending in node.keys:
            for k in v.order_keys(v.stored(evaluate(e, out.scope, self.functions))):
                keys.append(k.asc_nulls_first() if ascending else k.desc_nulls_last())
        return Solution(out.df.orderBy(*keys), out.infos)

    def _slice(self, node: a.Slice) -> Solution:
        out = self.solve(node.child)
        df = out.df.offset(node.offset) if node.offset else out.df
        return Solution(df if node.limit is None else df.limit(node.limit), out.infos)

    def _group(self, node: a.Group) -> Solution:
        child = self.solve(node.child)
        for n in node.keys:
            if n not in child.infos:
                child = child.with_value(n, v.null())
        cols, scope = [], child.scope
        for name, agg in node.aggregates:
            cols += [c.alias(name + suffix) for c, suffix in aggregates.aggregate(agg, scope, self.functions)]
        if node.keys:
            df = child.df.groupBy(*node.keys)
            df = df.agg(*cols) if cols else child.df.select(*node.keys).distinct()
        else:
            df = child.df.agg(*(cols or [F.count(F.lit(1)).alias("_n")]))
        infos = {n: child.infos[n] for n in node.keys}
        out = [F.col(n) for n in node.keys]
        for name, agg in node.aggregates:
            value, info = aggregates.result(agg, name, scope, self.functions)
            out.append(value.col.alias(name))
            infos[name] = info
        return Solution(df.select(*out) if out else df.select(F.lit(1).alias("_one")), infos)


#: Patterns that are solved as they are; values of outer variables are joined to them.
_LEAVES = (a.BGP, a.Path, a.Values, a.Empty, a.Graph, a.Service, a.Project, a.Distinct, a.Reduced, a.OrderBy, a.Slice, a.Group)


def _beyond(node: object, outer: set[str]) -> set[str]:
    """The outer variables whose values matter to a pattern of EXISTS otherwise than by agreeing with its solutions."""
    if isinstance(node, a.Project | a.Group):
        return set()
    out = set().union(*(_beyond(c, outer) for c in a.children(node)))
    if isinstance(node, a.Filter):
        out |= set(_used(node.condition)) - a.bound(node.child)
    elif isinstance(node, a.Extend):
        out |= set(_used(node.value)) - a.bound(node.child)
    elif isinstance(node, a.LeftJoin):
        out |= a.in_scope(node.right) - a.bound(node.left)
        if node.condition is not None:
            out |= set(_used(node.condition)) - a.bound(node.left) - a.bound(node.right)
    elif isinstance(node, a.Minus):
        out |= a.in_scope(node.right)
    return out & outer


def _assigned(node: object) -> set[str]:
    return set().union({node.name} if isinstance(node, a.Extend) else set(), *(_assigned(c) for c in a.children(node)))


def _branches(node: object) -> list:
    """Patterns without UNION at their top whose solutions together are those of the pattern."""
    if isinstance(node, a.Union):
        return [*_branches(node.left), *_branches(node.right)]
    if isinstance(node, a.Filter):
        return [a.Filter(node.condition, b) for b in _branches(node.child)]
    if isinstance(node, a.Join):
        left, right = _branches(node.left), _branches(node.right)
        if len(left) * len(right) <= 16:
            return [a.Join(x, y) for x in left for y in right]
    return [node]


def _pulled(node: object, outer: set[str]) -> tuple[object, list]:
    """A pattern without the conditions that mention outer variables, and those conditions."""
    if isinstance(node, a.Filter):
        child, up = _pulled(node.child, outer)
        stay = []
        for c in a.conjuncts(node.condition):
            outside = (set(_used(c)) & outer) - a.bound(node.child)
            (up if outside and not a.has_exists(c) else stay).append(c)
        return (a.Filter(reduce(lambda x, y: a.Call("&&", (x, y)), stay), child) if stay else child), up
    if isinstance(node, a.Join):
        sides = [_pulled(x, outer) for x in (node.left, node.right)]
        for (_, up), own, other in zip(sides, (node.left, node.right), (node.right, node.left), strict=True):
            # a condition must not come to see what only the other side binds
            if any((set(_used(c)) & a.in_scope(other)) - a.bound(own) - outer for c in up):
                return node, []
        return a.Join(sides[0][0], sides[1][0]), [*sides[0][1], *sides[1][1]]
    return node, []


def _native(term: object, kind: str) -> object:
    if kind == "term":
        return row(canonical(term))
    return int(canonical(term).lexical) if kind == "integer" else term.value if isinstance(term, IRI) else term.lexical


def _mentions(node: object) -> list[str]:
    """Each mention of a variable (or a hidden one) in a pattern, its expressions and its projections."""
    out: list[str] = []
    if isinstance(node, a.BGP):
        for t in node.triples:
            for x in (t.s, t.p, t.o):
                out += a.term_names(x)
    elif isinstance(node, a.Path):
        out += [*a.term_names(node.s), *a.term_names(node.o)]
    elif isinstance(node, a.Project | a.Values):
        out += node.names
    elif isinstance(node, a.Group):
        out += node.keys
        for _, agg in node.aggregates:
            out += _used(agg.arg) if agg.arg is not None else []
            if agg.arg is None and agg.distinct:
                out += [n for n in a.in_scope(node.child) for _ in range(2)]
    elif isinstance(node, a.Extend):
        out += [node.name, *_used(node.value)]
    elif isinstance(node, a.Filter):
        out += _used(node.condition)
    elif isinstance(node, a.LeftJoin) and node.condition is not None:
        out += _used(node.condition)
    elif isinstance(node, a.OrderBy):
        for e, _ in node.keys:
            out += _used(e)
    for child in a.children(node):
        out += _mentions(child)
    return out


def _used(e: object) -> list[str]:
    if isinstance(e, a.Exists):
        return _mentions(e.pattern)
    if isinstance(e, a.Call):
        return [n for x in e.args for n in _used(x)]
    return [e.name] if isinstance(e, a.Ref) else []


__all__ = ["Blank", "Planner", "Var"]
