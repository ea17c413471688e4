"""Forward reasoning by semi-naive iteration, with incremental addition and deletion.

Facts are triples of encoded terms, one string for each, so that joins compare plain columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.errors import LimitError
from ternion.plans.checkpoints import saved
from ternion.reason import equality
from ternion.reason.rules import Pattern, Rule
from ternion.sources.store import COLUMNS

MOST_ROUNDS = 1000
SPO = ["s", "p", "o"]
_SEP = "\x1f"


@dataclass(frozen=True)
class Result:
    derived: DataFrame  # in the store's columns
    count: int | None  # None: not counted
    rounds: int


def encoded(triples: DataFrame) -> DataFrame:
    """Triples in the store's columns as (s, p, o): ``I`` and an IRI, ``B`` and a label, ``L`` and a literal's parts."""
    name = lambda k, v: F.concat(F.when(F.col(k) == t.BLANK, "B").otherwise("I"), F.col(v))
    o = F.when(F.col("k") == t.LITERAL, F.concat(F.lit("L"), "dt", F.lit(_SEP), "lang", F.lit(_SEP), "v")).otherwise(name("k", "v"))
    return triples.select(name("sk", "s").alias("s"), F.concat(F.lit("I"), "p").alias("p"), o.alias("o"))


def decoded(facts: DataFrame) -> DataFrame:
    """The inverse of encoded()."""
    kind = lambda c: F.when(F.startswith(F.col(c), F.lit("B")), t.BLANK).when(F.startswith(F.col(c), F.lit("L")), t.LITERAL).otherwise(t.IRI_KIND)
    rest = lambda c: F.substring(F.col(c), 2, 1 << 30)
    parts = F.split(rest("o"), _SEP, 3)
    literal = F.startswith(F.col("o"), F.lit("L"))
    return facts.select(
        kind("s").alias("sk"), rest("s").alias("s"), rest("p").alias("p"), kind("o").alias("k"), F.when(literal, parts[2]).otherwise(rest("o")).alias("v"), F.when(literal, parts[0]).otherwise("").alias("dt"), F.when(literal, parts[1]).otherwise("").alias("lang")
    )


def _scan(facts: DataFrame, pattern: Pattern) -> DataFrame:
    """A pattern's matches, a column for each variable."""
    seen: dict[str, str] = {}
    for x, c in zip(pattern, SPO, strict=True):
        if x[0] != "?":
            facts = facts.filter(F.col(c) == "I" + x)
        elif x in seen:
            facts = facts.filter(F.col(c) == F.col(seen[x]))
        else:
            seen[x] = c
    return facts.select(*(F.col(c).alias(x) for x, c in seen.items()))


#: Predicates of the schema; with the types of OWL they are what instances are reasoned by.
_SCHEMA = {t.RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range")} | {t.OWL + x for x in ("inverseOf", "hasValue", "onProperty", "someValuesFrom", "allValuesFrom")}

_TESTS = {
    "different": lambda x, y: x != y,
    "iri": lambda x: F.startswith(x, F.lit("I")),
    "blank": lambda x: F.startswith(x, F.lit("B")),
    "literal": lambda x: F.startswith(x, F.lit("L")),
}


def _heads(rule: Rule, sources: list[DataFrame]) -> DataFrame:
    """What a rule derives with each body pattern matched in its own source."""
    todo = [(_scan(f, p), p) for f, p in zip(sources, rule.body, strict=True)]
    out, _ = todo.pop(0)
    while todo:
        i = next((i for i, (d, _) in enumerate(todo) if set(d.columns) & set(out.columns)), 0)
        nxt, _ = todo.pop(i)
        shared = [c for c in nxt.columns if c in out.columns]
        out = out.join(nxt, shared) if shared else out.crossJoin(nxt)
    for name, *args in rule.tests:
        out = out.filter(_TESTS[name](*(F.col(f"`{x}`") for x in args)))
    value = lambda x: F.col(f"`{x}`") if x[0] == "?" else F.lit("I" + x)
    head = out.select(*(value(x).alias(c) for x, c in zip(rule.head, SPO, strict=True)))
    # a literal is no subject, and a predicate is an IRI
    return head.filter(~F.startswith(F.col("s"), F.lit("L")) & F.startswith(F.col("p"), F.lit("I")))


def _vocabulary(facts: DataFrame) -> set[str]:
    """The predicates and the classes of OWL and RDFS that occur; as small as the schema."""
    types = facts.filter((F.col("p") == "I" + t.TYPE) & (F.startswith(F.col("o"), F.lit("I" + t.OWL)))).select(F.col("o").alias("x"))
    return {r.x[1:] for r in facts.select(F.col("p").alias("x")).union(types).distinct().collect()}


def _applies(rule: Rule, known: set[str]) -> bool:
    """Whether the facts can match each pattern of the body, going by their predicates and OWL classes."""
    return all((p[0] == "?" or p in known) and (p != t.TYPE or o[0] == "?" or not o.startswith(t.OWL) or o in known) for _, p, o in rule.body)


def _of_schema(pattern: tuple[str, str, str]) -> bool:
    """Whether a body pattern matches schema triples only."""
    _, p, o = pattern
    return p in _SCHEMA or (p == t.TYPE and o.startswith(t.OWL))


def schema_of(facts: DataFrame) -> DataFrame:
    """The schema triples among facts: a table of its own, so that Spark knows its size and broadcasts it while it is small."""
    return facts.filter(F.col("p").isin([f"I{p}" for p in sorted(_SCHEMA)]) | ((F.col("p") == "I" + t.TYPE) & F.startswith(F.col("o"), F.lit("I" + t.OWL))))


def derive(rules: Iterable[Rule], facts: DataFrame, delta: DataFrame, known: set[str], schema: DataFrame | None = None) -> DataFrame | None:
    """What the rules derive from facts with at least one pattern matched in delta (a part of facts).  schema: the facts that schema_of gives."""
    found = []
    whole = lambda pattern: schema if schema is not None and _of_schema(pattern) else facts
    for rule in rules:
        if not _applies(rule, known):
            continue
        if len(rule.body) == 1:
            found.append(_heads(rule, [delta]))
            continue
        if delta is facts:
            found.append(_heads(rule, [whole(p) for p in rule.body]))
            continue
        for i in range(len(rule.body)):
            found.append(_heads(rule, [delta if i == j else whole(p) for j, p in enumerate(rule.body)]))
    return reduce(DataFrame.unionAll, found) if found else None


def _closed(rules: list[Rule], facts: DataFrame, delta: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame | None, int]:
    """All new facts, round by round; ``only`` restricts them.  Each round saves the new ones alone."""
    new_facts: list[DataFrame] = []
    since: list[DataFrame] = []  # those not yet taken out of only
    wanted: list[str] = []
    if only is not None:  # what is looked for, so that no round compares all that is derived with all facts
        only = saved(only.join(facts, SPO, "left_anti"), "only")
        wanted = [r.p for r in only.select("p").distinct().collect()]
    rounds, vocabulary, schema = 0, _vocabulary(facts), saved(schema_of(facts), "schema")
    while rounds < MOST_ROUNDS:
        made = derive(rules, facts, delta, vocabulary, schema)
        if made is None:
            break
        if only is None:
            made = made.distinct().join(facts, SPO, "left_anti")
        else:
            # the predicates reach the scans and leave out rules that give others
            made = only.join(made.filter(F.col("p").isin(wanted)), SPO, "left_semi")
            if since:
                made = made.join(reduce(DataFrame.unionAll, since), SPO, "left_anti")
        rounds += 1
        delta = saved(made, "delta")
        if delta.isEmpty():
            break
        new_facts.append(delta)
        since.append(delta)
        facts = facts.unionAll(delta)
        more = _vocabulary(delta)
        if more & _SCHEMA or any(x.startswith(t.OWL) for x in more):
            schema = saved(schema.unionAll(schema_of(delta)), "schema")
        vocabulary |= more
        if rounds % 8 == 0:  # many folders are read as one again
            facts = saved(facts, "facts")
            if only is not None:
                only, since = saved(only.join(reduce(DataFrame.unionAll, since), SPO, "left_anti"), "only"), []
    else:
        raise LimitError(f"no fixpoint after {MOST_ROUNDS} rounds")
    return (reduce(DataFrame.unionAll, new_facts) if new_facts else None), rounds


def _result(triples: DataFrame, found: DataFrame | None, rounds: int) -> Result:
    if found is None:
        return Result(triples.limit(0), 0, rounds)
    found = saved(decoded(found), "derived")
    return Result(found, found.count(), rounds)


def materialize(triples: DataFrame, rules: list[Rule], spread: bool = True) -> Result:
    """All triples that the rules derive from the given ones (in the store's columns), which are not among them.

    spread: False leaves what follows from equality in its classes, to be made when and as far as it is read.
    """
    facts = saved(encoded(triples).distinct(), "facts")
    if equality.fits(rules):
        found, rounds = equality.derived(facts, rules)
        return _result(triples.select(*COLUMNS), found, rounds) if spread else Result(decoded(found), None, rounds)
    return _result(triples.select(*COLUMNS), *_closed(rules, facts, facts))


def add(triples: DataFrame, derived: DataFrame, more: DataFrame, rules: list[Rule]) -> Result:
    """What adding more triples derives beyond triples and derived, without deriving these again."""
    known = saved(encoded(triples).unionAll(encoded(derived)).distinct(), "facts")
    new = saved(encoded(more).distinct().join(known, SPO, "left_anti"), "delta")
    if new.isEmpty():
        return Result(triples.limit(0), 0, 0)
    return _result(triples, *_closed(rules, known.unionAll(new), new))


def remove(triples: DataFrame, derived: DataFrame, gone: DataFrame, rules: list[Rule]) -> DataFrame:
    """The derived triples that remain when explicit ones go (delete and re-derive).

    First everything that may rest on a deleted triple is taken out, also round cycles; then what
    the rest still derives is put back.
    """
    explicit = saved(encoded(triples).distinct(), "facts")
    old = saved(encoded(derived).distinct(), "derived")
    lost = saved(encoded(gone).distinct().join(explicit, SPO, "left_semi"), "gone")
    every = explicit.unionAll(old)
    known, schema = _vocabulary(every), saved(schema_of(every), "schema")
    doubtful, delta = lost, lost
    for _ in range(MOST_ROUNDS):
        made = derive(rules, every, delta, known, schema)
        if made is None:
            break
        delta = saved(made.distinct().join(old, SPO, "left_semi").join(doubtful, SPO, "left_anti"), "delta")
        if delta.isEmpty():
            break
        doubtful = saved(doubtful.unionAll(delta), "doubtful")
    else:
        raise LimitError(f"no fixpoint after {MOST_ROUNDS} rounds")
    kept = explicit.join(lost, SPO, "left_anti")
    # without those that are explicit as well
    left = saved(old.join(doubtful, SPO, "left_anti").join(kept, SPO, "left_anti"), "left")
    sure = saved(kept, "facts").unionAll(left)
    again, _ = _closed(rules, sure, sure, only=doubtful)
    return saved(decoded(left if again is None else left.unionAll(again)), "derived")


def condition(name: str, *columns: Column) -> Column:
    """A rule's test on columns of encoded terms."""
    return _TESTS[name](*columns)
