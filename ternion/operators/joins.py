"""Joins of solution sequences: compatibility in the sense of SPARQL, hashed wherever it can be."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion.plans.solution import Info, Solution, common, in_form, meeting

_numbers = count()


def _renamed(right: Solution, names: list[str]) -> tuple[Solution, dict[str, str]]:
    to = {n: f"_r{next(_numbers)}_{n}" for n in names}
    if not to:
        return right, to
    df = right.df.select(*(F.col(c).alias(to.get(c, c)) for c in right.df.columns))
    return Solution(df, {to.get(n, n): i for n, i in right.infos.items()}), to


def _empty(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


class _Meeting:
    """The condition under which rows of two sides agree in all variables that both bind."""

    def __init__(self, left: Solution, right: Solution):
        self.shared = [n for n in left.infos if n in right.infos]
        self.forms = {n: meeting(left.infos[n], right.infos[n]) for n in self.shared}
        self.left = left
        self.right, self.to = _renamed(right, self.shared)
        self.never = [n for n in self.shared if self.forms[n] is None and not left.infos[n].nullable and not right.infos[n].nullable]
        self.maybe = [n for n in self.shared if left.infos[n].nullable or right.infos[n].nullable]

    def sides(self, n: str) -> tuple[Column, Column]:
        x, y = self.left.value(n), self.right.value(self.to[n])
        form = self.forms[n]
        if form is None:
            return x.col, y.col
        return in_form(x, form), in_form(y, form)

    def equal(self, n: str) -> Column:
        if self.forms[n] is None:
            return F.lit(False)
        x, y = self.sides(n)
        return x == y

    def loose(self, n: str) -> Column:
        """Equal, or not bound on a side where that can be."""
        x, y = self.left.value(n), self.right.value(self.to[n])
        out = self.equal(n)
        if x.nullable:
            out = out | x.col.isNull()
        if y.nullable:
            out = out | y.col.isNull()
        return out

    def condition(self) -> Column:
        tests = [self.loose(n) if n in self.maybe else self.equal(n) for n in self.shared]
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _merged(meet: _Meeting, df: DataFrame, outer: bool) -> Solution:
    """One column for each variable of either side."""
    infos: dict[str, Info] = {}
    cols = []
    for n, info in meet.left.infos.items():
        if n in meet.to and info.nullable:
            other = meet.right.infos[meet.to[n]]
            form = common(info, other)
            cols.append(F.coalesce(in_form(meet.left.value(n), form), in_form(meet.right.value(meet.to[n]), form)).alias(n))
            infos[n] = Info(form.kind, form.template, info.nullable and (other.nullable or outer))
        else:
            cols.append(F.col(n))
            infos[n] = info
    for n, info in meet.right.infos.items():
        if n not in meet.to.values():
            cols.append(F.col(n))
            infos[n] = info.maybe() if outer else info
    return Solution(df.select(*cols) if cols else df.select(F.lit(1).alias("_one")), infos)


def split(side: Solution, n: str) -> list[Solution]:
    """The rows that bind n, where it is never null, and those that don't, without it."""
    if not side.infos[n].nullable:
        return [side]
    with_n, without = side.filter(F.col(n).isNotNull()), side.filter(F.col(n).isNull())
    infos = {m: Info(i.kind, i.template) if m == n else i for m, i in side.infos.items()}
    rest = {m: i for m, i in side.infos.items() if m != n}
    return [Solution(with_n.df, infos), Solution(without.df.drop(n) if rest else without.df.select(F.lit(1).alias("_one")), rest)]


def _unhashed(meet: _Meeting) -> str | None:
    """A variable that may be unbound, where the sides share no other that both always bind."""
    return meet.maybe[0] if meet.maybe and len(meet.maybe) == len(meet.shared) and not meet.never else None


def join(left: Solution, right: Solution) -> Solution:
    """All pairs that agree.

    Variables that both sides always bind are equi-join keys.  One that may be unbound would make
    the condition a disjunction, and without other keys a nested loop; such a join is taken apart
    into the rows that bind it on both sides and those that don't, so that the first part is hashed.
    """
    meet = _Meeting(left, right)
    if n := _unhashed(meet):
        parts = [join(x, y) for x in split(left, n) for y in split(right, n)]
        return reduce(union, parts)
    a = Solution(left.df.withColumn("_one", F.lit(1)) if not left.infos else left.df, left.infos)
    b = meet.right
    if not b.infos and "_one" in b.df.columns:
        b = Solution(b.df.select(F.lit(1).alias("_two")), b.infos)
    if meet.never:
        df = _empty(a.df.crossJoin(b.df))
    elif not meet.shared:
        df = a.df.crossJoin(b.df)
    else:
        df = a.df.join(b.df, meet.condition(), "inner")
    return _merged(meet, df, False)


def left_join(left: Solution, right: Solution, test=None) -> Solution:
    """OPTIONAL: every left row, with each right row that agrees and passes ``test`` (a function of the merged scope)."""
    meet = _Meeting(left, right)
    if _unhashed(meet):
        matched = join(left, right)
        if test is not None:
            matched = matched.filter(F.coalesce(test(matched.scope), F.lit(False)))
        return union(matched, semi_join(left, right, True, test))
    on = F.lit(False) if meet.never else meet.condition()
    if test is not None:
        scope = {n: meet.right.value(meet.to.get(n, n)) for n in right.infos}
        for n in left.infos:
            scope[n] = left.value(n)
        on = on & F.coalesce(test(scope), F.lit(False))
    b = meet.right.df if meet.right.infos else meet.right.df.select(F.lit(1).alias("_two"))
    return _merged(meet, left.df.join(b, on, "left"), True)


def semi_join(left: Solution, right: Solution, anti: bool = False, test=None) -> Solution:
    """EXISTS and, with ``anti``, NOT EXISTS: left rows that some right row agrees with, or none does."""
    meet = _Meeting(left, right)
    if n := _unhashed(meet):
        if left.infos[n].nullable:
            return reduce(union, (semi_join(part, right, anti, test) for part in split(left, n)))
        bound, free = split(right, n)
        rest = semi_join(left, bound, True, test)
        return semi_join(rest, free, True, test) if anti else union(semi_join(left, bound, False, test), semi_join(rest, free, False, test))
    on = F.lit(False) if meet.never else meet.condition()
    if test is not None:
        scope = {n: meet.right.value(meet.to.get(n, n)) for n in right.infos}
        for n in left.infos:
            scope[n] = left.value(n)
        on = on & F.coalesce(test(scope), F.lit(False))
    how = "left_anti" if anti else "left_semi"
    return Solution(left.df.join(meet.right.df, on, how), left.infos)


def minus(left: Solution, right: Solution, constant: set[str] = frozenset()) -> Solution:
    """MINUS: left rows that agree with no right row with which they share a bound variable, ``constant`` ones not counted."""
    meet = _Meeting(left, right)
    free = [n for n in meet.shared if n not in constant]
    if not free or meet.never:
        return left
    if n := _unhashed(meet):
        if left.infos[n].nullable:
            return reduce(union, (minus(part, right, constant) for part in split(left, n)))
        bound, rest = split(right, n)
        return minus(minus(left, bound, constant), rest, constant)
    on = meet.condition()
    if all(n in meet.maybe for n in free):
        both = [left.value(n).col.isNotNull() & meet.right.value(meet.to[n]).col.isNotNull() for n in free]
        on = on & reduce(lambda a, b: a | b, both)
    return Solution(left.df.join(meet.right.df, on, "left_anti"), left.infos)


def union(left: Solution, right: Solution) -> Solution:
    """All rows of both; variables that one side lacks are unbound there."""
    infos: dict[str, Info] = {}
    for n in [*left.infos, *(n for n in right.infos if n not in left.infos)]:
        if n in left.infos and n in right.infos:
            infos[n] = common(left.infos[n], right.infos[n])
        else:
            infos[n] = (left.infos.get(n) or right.infos[n]).maybe()
    return Solution(left.cast(infos).df.unionAll(right.cast(infos).df), infos)


def marked(left: Solution, right: Solution, name: str) -> Solution:
    """Left rows with a boolean column telling whether some right row agrees; shared variables are always bound."""
    shared = [n for n in left.infos if n in right.infos]
    keys = right.only(shared) if shared else Solution(right.df.select(F.lit(1).alias("_one")).limit(1), {})
    keys = Solution(keys.df.distinct().withColumn(name, F.lit(True)), keys.infos | {name: Info("boolean")})
    meet = _Meeting(left, keys)
    on = F.lit(False) if meet.never else meet.condition()
    df = left.df.join(meet.right.df.select(*meet.to.values(), name), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return Solution(df.select(*left.df.columns, name), left.infos | {name: Info("boolean")})


def _same(left: list[str], right: list[str]) -> Column:
    tests = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def marked_by(left: Solution, hits: Solution, names: list[str], name: str) -> Solution:
    """Left rows with a boolean column telling whether their values of ``names`` are one of the hits, which are all different."""
    to = [f"_m{next(_numbers)}_{n}" for n in names]
    keys = hits.df.select(*(F.col(n).alias(x) for n, x in zip(names, to, strict=True)), F.lit(True).alias(name))
    df = left.df.join(keys, _same(names, to), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return Solution(df.select(*left.df.columns, name), left.infos | {name: Info("boolean")})


def kept_apart(left: Solution) -> tuple[Solution, dict[str, str]]:
    """Left rows with a copy of each variable under a name of its own, which joins leave as it is."""
    to = {n: f"_k{next(_numbers)}_{n}" for n in left.infos}
    df = left.df.select("*", *(F.col(n).alias(x) for n, x in to.items()))
    return Solution(df, left.infos | {x: left.infos[n] for n, x in to.items()}), to


def without(left: Solution, both: Solution, to: dict[str, str]) -> Solution:
    """Left rows whose values aren't among the copies in ``both``."""
    keys = both.df.select(*to.values()) if to else both.df.select(F.lit(1).alias("_two"))
    return Solution(left.df.join(keys, _same(list(to), list(to.values())), "left_anti"), left.infos)
