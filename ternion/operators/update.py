"""SPARQL Update over versions of a store."""

from __future__ import annotations

from collections.abc import Callable

from ternion.errors import LimitError
from ternion.functions.scalar import Registry
from ternion.operators.forms import instantiate
from ternion.plans import algebra as a
from ternion.plans.checkpoints import saved
from ternion.plans.dataset import Dataset
from ternion.plans.planner import Planner
from ternion.plans.rewrite import rewrite
from ternion.plans.solution import Solution
from ternion.sources.store import COLUMNS, TripleStore

#: Triples in the text of one request.
MOST_DATA, MOST_TEMPLATE = 100_000, 1000


def apply(store: TripleStore, op: object, data: Callable[[TripleStore], Dataset], load: Callable[[TripleStore, str], tuple[TripleStore, int]], functions: Registry | None = None) -> tuple[TripleStore, int]:
    """The version after one operation, and how many triples it deleted and inserted.

    WHERE is evaluated once, over the version before; deletions come before insertions.  INSERT DATA
    counts the triples given, DELETE DATA those that were there.
    """
    if isinstance(op, a.Create):
        return store, 0
    if isinstance(op, a.Clear):
        if op.target in ("DEFAULT", "ALL"):
            n = store.df.count()
            return TripleStore.empty(store.df.sparkSession), n
        return store, 0  # there are no named graphs
    if isinstance(op, a.Load):
        try:
            return load(store, op.source)
        except Exception:
            if op.silent:
                return store, 0
            raise
    assert isinstance(op, a.Modify)
    if len(op.delete) + len(op.insert) > (MOST_DATA if op.pattern is None else MOST_TEMPLATE):
        raise LimitError("too many triples in one update")
    if op.pattern is None:
        spark = store.df.sparkSession
        one = Solution(spark.range(1), {})
        if op.insert:
            return store.plus(instantiate(op.insert, one)), len(op.insert)
        gone = instantiate(op.delete, one)
        n = store.df.join(gone, COLUMNS, "left_semi").count()
        return store.less(gone), n
    names = {x for tr in (*op.delete, *op.insert) for y in (tr.s, tr.p, tr.o) for x in a.term_names(y)}
    sol = Planner(data(store), functions).plan(rewrite(op.pattern), {n for n in names for _ in range(2)} | names)
    keep = [n for n in sol.infos if n in names]
    held = sol.only(keep)
    held = Solution(saved(held.df.distinct() if keep else held.df, "where"), held.infos)
    # blank nodes of a pattern are variables, and so is what DELETE WHERE repeats of it
    deleted = instantiate(tuple(_named(tr) for tr in op.delete), held) if op.delete else None
    inserted = instantiate(op.insert, held) if op.insert else None
    n = 0
    if deleted is not None:
        deleted = saved(deleted.join(store.df, COLUMNS, "left_semi"), "deleted")
        n += deleted.count()
        store = store.less(deleted)
    if inserted is not None:
        inserted = saved(inserted, "inserted")
        n += inserted.count()
        store = store.plus(inserted)
    return store, n


def _named(tr: a.Triple) -> a.Triple:
    from ternion.terms import Blank, Var

    name = lambda x: Var(a.blank_name(x)) if isinstance(x, Blank) else x
    return a.Triple(name(tr.s), tr.p, name(tr.o))
