"""Equality by classes: sameAs ties terms to classes, which are spread out only when what follows is read.

Joined pair by pair, the transitive rule makes as many rows as the cube of a class's size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.errors import LimitError
from ternion.plans.checkpoints import saved
from ternion.reason.rules import BY_NAME, Rule

#: Rounds of the components grow with the logarithm of the longest way.
MOST_ROUNDS = 60
#: Groups of copied facts that a task spreads out.
GROUPS_A_TASK = 10_000
_SAME = "I" + t.OWL + "sameAs"
_EQUALITY = {"eq_sym", "eq_trans", "eq_rep_s"}


def fits(rules: Iterable[Rule]) -> bool:
    """Whether classes give all that the rules derive: equality of subjects, and what follows from inverse functional properties."""
    rules = list(rules)
    names = {r.name for r in rules}
    return all(BY_NAME.get(r.name) == r for r in rules) and _EQUALITY <= names <= _EQUALITY | {"prp_ifp"}


def classes(ties: DataFrame) -> tuple[DataFrame, int]:
    """(x, root) for each end of the ties (a, b), root being the least term reachable; and the rounds.  Large-star and small-star steps in turn."""
    now = saved(ties.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "ties")
    before = None
    for rounds in range(MOST_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", "low")).filter("a <> b").distinct()
        now = saved(small, "ties")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            return saved(now.select(F.col("a").alias("x"), F.col("b").alias("root")).union(now.select("b", "b").distinct()), "classes"), rounds + 1
        before = mark
    raise LimitError(f"no classes after {MOST_ROUNDS} rounds")


def derived(facts: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, int]:
    """What rules that fit derive from encoded facts and is not among them, each once, and the rounds.

    Classes, and a row for each fact of a class, are saved; pairs and copies are made from them when
    the result is read.  A literal is in no class: sameAs to one is a fact like others.
    """
    alike = (F.col("p") == _SAME) & ~F.startswith(F.col("o"), F.lit("L"))
    given = saved(facts.filter(alike), "same")
    ties = given.select(F.col("s").alias("a"), F.col("o").alias("b"))
    keys = facts.filter((F.col("p") == "I" + t.TYPE) & (F.col("o") == f"I{t.OWL}InverseFunctionalProperty")).select(F.col("s").alias("p"))
    keys = saved(keys if "prp_ifp" in {r.name for r in rules} else keys.limit(0), "keys")
    rounds = 0
    while True:
        held = facts.join(keys, "p")
        least = held.groupBy("p", "o").agg(F.min("s").alias("b"))
        members, n = classes(ties.union(held.join(least, ["p", "o"]).select(F.col("s").alias("a"), "b")))
        rounds += n
        # a property that equals an inverse functional one is one, too
        roots = members.join(keys, F.col("x") == F.col("p"), "left_semi").select("root").distinct()
        more = members.join(roots, "root").select(F.col("x").alias("p")).join(keys, "p", "left_anti")
        if more.isEmpty():
            break
        keys = saved(keys.union(more), "keys")
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    groups = facts.filter(~alike).join(members, F.col("s") == F.col("x")).groupBy("root", "p", "o").agg(F.count("*").alias("n"), F.min("s").alias("owner"))
    groups = saved(groups.join(sizes, "root").filter("n < size"), "copied")
    parts = max(4 * facts.sparkSession.sparkContext.defaultParallelism, groups.count() // GROUPS_A_TASK)
    # by more than the class, as a few large ones would leave most tasks without work
    spread = groups.repartition(parts, "root", "p", "o").join(members, "root")
    out = spread.filter("n = 1 and x <> owner").select(F.col("x").alias("s"), "p", "o")
    if not groups.filter("n > 1").isEmpty():
        out = out.unionAll(spread.filter("n > 1").select(F.col("x").alias("s"), "p", "o").join(facts, ["s", "p", "o"], "left_anti"))
    pairs = members.select(F.col("x").alias("s"), "root").repartition(parts, "s").join(members, "root").select("s", F.lit(_SAME).alias("p"), F.col("x").alias("o"))
    if not given.isEmpty():
        pairs = pairs.join(given, ["s", "p", "o"], "left_anti")
    return out.unionAll(pairs), rounds
