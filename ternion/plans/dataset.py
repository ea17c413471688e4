"""The graph that a query runs over: stored triples, derived ones, and mapped tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ternion.operators.joins import union
from ternion.plans.algebra import Triple, blank_name, term_names
from ternion.plans.solution import Info, Solution
from ternion.sources.mapping import Mapping
from ternion.sources.store import TripleStore
from ternion.terms import Blank, Var


@dataclass
class Dataset:
    spark: SparkSession
    store: TripleStore | None = None
    mapping: Mapping | None = None

    def __post_init__(self) -> None:
        if self.store is not None and self.store.is_empty():
            self.store = None

    def nothing(self, names: list[str]) -> Solution:
        return Solution(self.spark.range(0).select(*(F.lit(None).cast("string").alias(n) for n in names) if names else [F.lit(1).alias("_one")]), {n: Info("unbound", None, True) for n in names})

    def match(self, triple: Triple) -> Solution:
        """Solutions of one pattern over all parts of the graph."""
        found = [s for part in (self.store, self.mapping) if part is not None and (s := part.match(triple))]
        names = sorted(set().union(*(term_names(x) for x in (triple.s, triple.p, triple.o))))
        return reduce(union, found) if found else self.nothing(names)

    def units(self, triples: tuple[Triple, ...], mentions: dict[str, int]) -> list[tuple[float, Solution, set[str]]]:
        """The patterns as solutions to be joined, each with its estimated size and the variables of which a value has one row.

        Over mapped tables all patterns of one subject are a single scan.  Its subject is left out
        where nothing else mentions it.
        """
        if self.mapping is None or self.store is not None:
            return [(self._size(t), self.match(t), set()) for t in triples]
        stars: dict[object, list[Triple]] = {}
        units = []
        for t in triples:
            if isinstance(t.p, Var):
                units.append((1e18, self.match(t), set()))
            else:
                stars.setdefault(t.s, []).append(t)
        for subject, star in stars.items():
            pairs = [(t.p, t.o) for t in star]
            name = subject.name if isinstance(subject, Var) else blank_name(subject) if isinstance(subject, Blank) else None
            need = name is None or mentions.get(name, 0) > len(star)
            found = self.mapping.star(subject, pairs, need)
            if found is None:
                names = sorted(set().union(*(term_names(x) for t in star for x in (t.s, t.o))))
                units.append((0.0, self.nothing(names), set()))
            else:
                fixed = sum(not isinstance(o, Var | Blank) for p, o in pairs if "type" not in p.value) + (name is None) * 3
                units.append((self.mapping.size(pairs) / 10**fixed, found, {name} & found.infos.keys() if self.mapping.keyed(pairs) else set()))
        return units

    def _size(self, t: Triple) -> float:
        return (self.store.size(t) if self.store else 0) + (self.mapping.size([(t.p, t.o)]) if self.mapping else 0)

    def nodes(self) -> Solution:
        """Every subject and object once, as column n."""
        found = []
        if self.store is not None:
            found.append(Solution(self.store.nodes(), {"n": Info("term")}))
        if self.mapping is not None:
            every = self.mapping.match(Triple(Var("n"), Var("_p"), Var("_o")))
            for end in ("n", "_o"):
                found.append(Solution(every.df.select(F.col(end).alias("n")), {"n": every.infos[end]}))
        all_ = reduce(union, found) if found else self.nothing(["n"])
        return Solution(all_.df.distinct(), all_.infos)
