"""Property paths: fixed steps as joins and unions, repetition as a fixpoint over saved rounds."""

from __future__ import annotations

from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternion.errors import LimitError, UnsupportedError
from ternion.functions.values import Template, Value, constant, same_term
from ternion.operators.joins import join, union
from ternion.plans import algebra as a
from ternion.plans.checkpoints import saved
from ternion.plans.solution import Info, Solution, common, in_form
from ternion.terms import IRI, Blank, Literal, Var

if TYPE_CHECKING:
    from ternion.plans.dataset import Dataset

#: Rounds after which a fixpoint is given up with an error.
MOST_ROUNDS = 1000
#: Edges up to which a search from one start runs on the driver, which saves a job for each step.
DRIVER_EDGES = 50_000

_numbers = count()


def _name(x: object) -> str | None:
    return x.name if isinstance(x, Var) else a.blank_name(x) if isinstance(x, Blank) else None


def path(data: Dataset, s: object, p: object, o: object) -> Solution:
    """Solutions of s p o.  Sequences and alternatives keep duplicates; ``*``, ``+`` and ``?`` give sets."""
    if isinstance(p, a.Link):
        return data.match(a.Triple(s, IRI(p.iri), o))
    if isinstance(p, a.Inverse):
        return path(data, o, p.path, s)
    if isinstance(p, a.Sequence):
        middle = Blank(f"mid{next(_numbers)}")
        both = join(path(data, s, p.left, middle), path(data, middle, p.right, o))
        return both.only([n for n in both.infos if n != a.blank_name(middle)])
    if isinstance(p, a.Alternative):
        return union(path(data, s, p.left, o), path(data, s, p.right, o))
    if isinstance(p, a.Negated):
        return _negated(data, s, p, o)
    if isinstance(p, a.Repeat):
        return _repeat(data, s, p, o)
    raise UnsupportedError(f"path {type(p).__name__}")


def _negated(data: Dataset, s: object, p: a.Negated, o: object) -> Solution:
    found = []
    for ahead, names in ((True, p.forward), (False, p.inverse)):
        if names is None or ahead and not p.ahead:
            continue
        used = Var(f"_not{next(_numbers)}")
        step = data.match(a.Triple(s, used, o) if ahead else a.Triple(o, used, s))
        step = step.filter(~F.col(used.name).isin(*names)) if names else step
        found.append(step.only([n for n in step.infos if n != used.name]))
    return found[0] if len(found) == 1 else union(*found)


def edges(data: Dataset, p: object) -> tuple[DataFrame, Info]:
    """The distinct steps (a, b) of a path, both ends in one form."""
    step = path(data, Var("_a"), p, Var("_b"))
    form = common(step.infos["_a"], step.infos["_b"])
    form = Info(form.kind, form.template)
    ends = step.cast({"_a": form, "_b": form}).df.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return ends.distinct(), form


def closure(steps: DataFrame) -> DataFrame:
    """All (a, b) with a way of one step or more from a to b.  Ways double in length with each round.

    A shortest way that is longer than all known ones begins with one of exactly the greatest known
    length, which the last round found, and goes on with a known one.  Each round's pairs stay in their own folder.
    """
    known = new = saved(steps, "steps")
    for _ in range(MOST_ROUNDS):
        more = new.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        new = saved(more.join(known, ["a", "b"], "left_anti"), "round")
        if new.isEmpty():
            return known
        known = known.union(new)
    raise LimitError(f"a path is longer than {MOST_ROUNDS} rounds")


def reach(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """The distinct (s, b) that the starts s reach in one step or more.

    Up to DRIVER_EDGES steps and one start the search is done on the driver; else each round is a
    join of the newly reached with the steps, and what was reached before is left out.
    """
    steps = saved(steps, "steps")
    if len(begin := starts.limit(2).collect()) == 1 and steps.count() <= DRIVER_EDGES:
        out: dict = {}
        for r in steps.collect():
            out.setdefault(r.a, []).append(r.b)
        seen, todo = set(), [begin[0].s]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        spark = steps.sparkSession
        kind = starts.schema["s"].dataType
        schema = f"b {steps.schema['b'].dataType.simpleString()}"
        return starts.crossJoin(spark.createDataFrame([(b,) for b in seen], schema)).select(F.col("s").cast(kind), "b")
    known, new = None, starts.select("s", F.col("s").alias("m"))
    for _ in range(MOST_ROUNDS):
        nxt = new.join(steps.select(F.col("a").alias("m"), "b"), "m").select("s", "b").distinct()
        if known is not None:
            nxt = nxt.join(known, ["s", "b"], "left_anti")
        nxt = saved(nxt, "round")
        if nxt.isEmpty():
            return known if known is not None else nxt
        known = nxt if known is None else known.union(nxt)
        new = nxt.select("s", F.col("b").alias("m"))
    raise LimitError(f"a path is longer than {MOST_ROUNDS} steps")


def _in_form(x: object, form: Info) -> Value | None:
    """A constant end in the form of the steps; None if it can't be the end of one."""
    if isinstance(x, Literal) and form.kind == "iri":
        return None
    value = constant(x)
    if form.template and (not isinstance(x, IRI) or form.template.key(x.value) is None):
        return None
    return Value(form.kind, in_form(value, form), form.template)


def _repeat(data: Dataset, s: object, p: a.Repeat, o: object) -> Solution:
    s_name, o_name = _name(s), _name(o)
    spark = data.spark
    steps, form = edges(data, p.path)
    if s_name is None and o_name is not None or s_name is not None and o_name is None:
        # one end is given: search from it, backward if it is the object
        start, end, flip = (s, o_name, False) if s_name is None else (o, s_name, True)
        if flip:
            steps = steps.select(F.col("b").alias("a"), F.col("a").alias("b"))
        at = _in_form(start, form)
        if at is None:
            found = Solution(steps.filter(F.lit(False)).select(F.col("b").alias(end)), {end: form})
        else:
            if p.many:
                ends = reach(steps, spark.range(1).select(at.col.alias("s"))).select("b")
            else:
                ends = steps.filter(F.col("a") == at.col).select("b")
            found = Solution(ends.select(F.col("b").alias(end)), {end: form})
        if p.least == 0:
            own = constant(start)
            same = Solution(spark.range(1).select(own.col.alias(end)), {end: Info(own.kind)})
            found = union(found, same)
            found = Solution(found.df.distinct(), found.infos)
        return found
    if s_name is None:
        # both ends are given: one empty solution or none
        x, y = _in_form(s, form), _in_form(o, form)
        yes = spark.range(1).select(F.lit(1).alias("_one"))
        if p.least == 0 and s == o:
            return Solution(yes, {})
        if x is None or y is None:
            return Solution(yes.filter(F.lit(False)), {})
        met = reach(steps, spark.range(1).select(x.col.alias("s"))) if p.many else steps.filter(F.col("a") == x.col)
        return Solution(met.filter(F.col("b") == y.col).limit(1).select(F.lit(1).alias("_one")), {})
    pairs = closure(steps) if p.many else steps
    found = Solution(pairs.select(F.col("a").alias("_s"), F.col("b").alias("_o")), {"_s": form, "_o": form})
    if p.least == 0:
        nodes = data.nodes()
        same = Solution(nodes.df.select(F.col("n").alias("_s"), F.col("n").alias("_o")), {"_s": nodes.infos["n"], "_o": nodes.infos["n"]})
        found = union(found, same)
        found = Solution(found.df.distinct(), found.infos)
    if s_name == o_name:
        one = found.filter(same_term(found.value("_s"), found.value("_o")))
        return Solution(one.df.select(F.col("_s").alias(s_name)), {s_name: one.infos["_s"]})
    return Solution(found.df.select(F.col("_s").alias(s_name), F.col("_o").alias(o_name)), {s_name: found.infos["_s"], o_name: found.infos["_o"]})


__all__ = ["Template", "closure", "edges", "path", "reach"]
