"""The engine: a graph, queries, updates, loading, export and reasoning over it."""

from __future__ import annotations

import hashlib
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternion import stats
from ternion import terms as t
from ternion.errors import QueryTimeout, TernionError, UnsupportedError
from ternion.functions.values import as_term
from ternion.operators import forms, update
from ternion.plans import algebra as a
from ternion.plans.dataset import Dataset
from ternion.plans.parser import parse_query, parse_update
from ternion.plans.planner import Planner
from ternion.plans.rewrite import rewrite
from ternion.plans.solution import Solution
from ternion.sources import io
from ternion.sources.mapping import Mapping, Table
from ternion.sources.store import COLUMNS, TripleStore, triples
from ternion.terms import IRI, Term, of_row, of_value

_cached_query = lru_cache(maxsize=1000)(parse_query)
_UNSTABLE = re.compile(r"\b(RAND|NOW|UUID|STRUUID|BNODE)\s*\(", re.IGNORECASE)


@dataclass(frozen=True)
class Prepared:
    """A parsed query with parameters written as $name."""

    query: a.Query
    parameters: frozenset[str]


def _bound(node: object, values: dict[str, Term]) -> object:
    """A pattern or expression with variables replaced by terms."""
    from dataclasses import fields, is_dataclass

    if isinstance(node, t.Var):
        return values.get(node.name, node)
    if isinstance(node, a.Ref):
        return a.Const(values[node.name]) if node.name in values else node
    if isinstance(node, tuple):
        return tuple(_bound(x, values) for x in node)
    if is_dataclass(node) and not isinstance(node, IRI | t.Blank | t.Literal):
        return replace(node, **{f.name: _bound(getattr(node, f.name), values) for f in fields(node)})
    return node


class Engine:
    """A graph and what can be done with it.

    The graph is stored triples (an immutable version that updates replace), mapped tables, and
    the triples that reasoning has derived.  Queries see one version from beginning to end.
    """

    def __init__(self, spark: SparkSession, tables: list[Table] | None = None, timeout: float | None = None):
        self.spark, self.timeout = spark, timeout
        self.mapping = Mapping(tables) if tables else None
        self.store = TripleStore.empty(spark)
        self.derived: TripleStore | None = None
        self.functions: dict[str, Callable] = {}
        self.lock = threading.RLock()
        self.version = 0
        self.log: OrderedDict[str, int] = OrderedDict()
        self._results: OrderedDict[str, DataFrame] = OrderedDict()
        from ternion.reason.status import Status

        self.status = Status()

    # queries

    def _dataset(self, store: TripleStore | None = None, source: str = "both") -> Dataset:
        """source: explicit, derived or both triples."""
        store = store if store is not None else self.store
        if self.derived is not None and source != "explicit":
            store = self.derived if source == "derived" else self._both(store)
        return Dataset(self.spark, store, self.mapping)

    def _both(self, store: TripleStore) -> TripleStore:
        if store is not self.store:
            return TripleStore(store.df.unionByName(self.derived.df))
        if getattr(self, "_union", None) is None or self._union[0] != self.version:
            self._union = (self.version, TripleStore(self.store.df.unionByName(self.derived.df).persist()))
        return self._union[1]

    def solutions(self, query: str | Prepared | a.Query, source: str = "both", optimize: bool = True) -> Solution:
        """The solutions of a query's pattern, with what is known about each variable."""
        q = query.query if isinstance(query, Prepared) else query if isinstance(query, a.Query) else _cached_query(query)
        pattern = rewrite(q.pattern) if optimize else q.pattern
        names = {n for tr in q.template for x in (tr.s, tr.p, tr.o) for n in a.term_names(x)} | {x.name for x in q.targets if isinstance(x, t.Var)}
        return Planner(self._dataset(source=source), self.functions).plan(pattern, {*names})

    def sparql(self, text: str | Prepared, *, terms: str = "native", source: str = "both", optimize: bool = True, timeout: float | None = None, cache: bool = False, **parameters: object) -> DataFrame | bool:
        """Answers a query: a DataFrame for SELECT, a boolean for ASK, triples for CONSTRUCT and DESCRIBE.

        SELECT gives a column for each variable: numbers, strings and times as Spark types, IRIs and
        terms of mixed kinds as text (``terms="native"``), all as TERM structs (``"struct"``) or as
        text (``"lexical"``).  ``parameters`` replace variables of the query.  ``cache`` keeps the
        result for the same text and version.  ASK and ``timeout`` run the query now.
        """
        prepared = text if isinstance(text, Prepared) else Prepared(_cached_query(text), frozenset())
        q = prepared.query
        if parameters:
            missing = set(parameters) - _names(q)
            if missing:
                raise TernionError(f"the query has no {sorted(missing)[0]}")
            values = {n: of_value(x) for n, x in parameters.items()}
            q = _bound(q, values)
            q = replace(q, names=tuple(n for n in q.names if n not in values)) if q.form == "SELECT" else q
            if q.form == "SELECT":
                q = replace(q, pattern=_unprojected(q.pattern, set(values)))
        key = None
        if cache and isinstance(text, str) and not _UNSTABLE.search(text):
            key = hashlib.sha256(repr((text, terms, source, sorted(parameters.items()), self.version)).encode()).hexdigest()
            if key in self._results:
                self._results.move_to_end(key)
                return self._results[key]
        with self._within(timeout if timeout is not None else self.timeout) as watch:
            out = self._answer(q, terms, source, optimize)
            if watch and isinstance(out, DataFrame):
                out = out.persist()
                out.count()
        if key is not None:
            self._results[key] = out.persist() if isinstance(out, DataFrame) else out
            while len(self._results) > 1000:
                self._results.popitem(last=False)
        return out

    def _answer(self, q: a.Query, terms: str, source: str, optimize: bool) -> DataFrame | bool:
        data = self._dataset(source=source)
        sol = self.solutions(q, source, optimize)
        if q.form == "ASK":
            return not sol.df.isEmpty()
        if q.form == "CONSTRUCT":
            return forms.instantiate(q.template, sol)
        if q.form == "DESCRIBE":
            return forms.describe(q, sol, data)
        if terms == "struct":
            return sol.terms()
        return sol.lexical() if terms == "lexical" else native(sol)

    def _within(self, seconds: float | None):
        return _Watch(self.spark, seconds)

    def prepare(self, text: str) -> Prepared:
        """Parses a query once; ``$name`` variables are its parameters."""
        names = frozenset(re.findall(r"\$(\w+)", re.sub(r'"(?:[^"\\]|\\.)*"|<[^>\s]*>', "", text)))
        return Prepared(parse_query(text), names)

    def execute(self, prepared: Prepared, parameters: dict[str, object] | None = None, **options: object) -> DataFrame | bool:
        given = set(parameters or {})
        if missing := prepared.parameters - given:
            raise TernionError(f"no value for ${sorted(missing)[0]}")
        return self.sparql(prepared, **options, **(parameters or {}))

    def stream(self, text: str, variables: list[str] | None = None) -> Iterator[dict[str, Term]]:
        """The solutions of a SELECT one by one on the driver; unbound variables are absent."""
        q = _cached_query(text)
        if q.form != "SELECT":
            raise UnsupportedError("only SELECT can be streamed")
        sol = self.solutions(q)
        names = [n for n in sol.infos if variables is None or n in variables]
        df = sol.df.select(*(as_term(sol.value(n)).alias(n) for n in names))
        for r in df.toLocalIterator():
            yield {n: of_row(*r[n]) for n in names if r[n] is not None}

    def explain(self, text: str) -> str:
        """The algebra as written and as rewritten, and Spark's plan."""
        q = _cached_query(text)
        sol = self.solutions(q)
        plan = sol.df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return f"== Algebra ==\n{a.show(q.pattern)}\n== Rewritten ==\n{a.show(rewrite(q.pattern))}\n{plan}"

    def register_function(self, iri: str, function: Callable) -> None:
        """A function for expressions: from the arguments' text, as columns, to a string column."""
        self.functions[iri] = function

    # changes

    def _commit(self, store: TripleStore) -> None:
        self.store = store
        self.version += 1
        if self.derived is not None:
            self.status.stale()

    def update(self, text: str) -> int:
        """Runs an update request; returns the triples deleted and inserted.  An error keeps what was done before it."""
        done = 0
        with self.lock:
            for op in parse_update(text).operations:
                store, n = update.apply(self.store, op, self._dataset, self._loaded, self.functions)
                self._commit(store)
                done += n
        return done

    def _loaded(self, store: TripleStore, source: str) -> tuple[TripleStore, int]:
        more = io.load(self.spark, source.removeprefix("file://"))
        return store.plus(more), more.count()

    def load(self, path: str, format: str | None = None, base: str = "", **options: object) -> int:
        """Loads a file, folder or glob; returns the triples in it."""
        more = io.load(self.spark, path, format, base, **options)
        with self.lock:
            self._commit(self.store.plus(more))
        return more.count()

    def load_string(self, text: str, format: str = "turtle", base: str = "") -> int:
        more = io.from_text(self.spark, text, format, base).persist()
        with self.lock:
            self._commit(self.store.plus(more))
        return more.count()

    def load_frame(self, df: DataFrame) -> int:
        """Loads triples that are already in the store's columns."""
        with self.lock:
            self._commit(self.store.plus(df))
        return df.count()

    def insert(self, rows: Iterable[tuple[Term, IRI, Term]] | tuple) -> int:
        rows = [rows] if isinstance(rows, tuple) else list(rows)
        with self.lock:
            self._commit(self.store.plus(triples(self.spark, rows)))
        return len(rows)

    def delete(self, rows: Iterable[tuple[Term, IRI, Term]] | tuple) -> int:
        rows = [rows] if isinstance(rows, tuple) else list(rows)
        with self.lock:
            self._commit(self.store.less(triples(self.spark, rows)))
        return len(rows)

    # export

    def triples(self, s: Term | None = None, p: IRI | None = None, o: Term | None = None, source: str = "both") -> DataFrame:
        """The graph's triples, or those of a pattern; None is any."""
        df = forms.all_triples(self._dataset(source=source)) if self.mapping else self._dataset(source=source).store
        df = df if isinstance(df, DataFrame) else df.df if df is not None else TripleStore.empty(self.spark).df
        if s is not None:
            k, v, _, _ = t.row(s)
            df = df.filter((F.col("sk") == k) & (F.col("s") == v))
        if p is not None:
            df = df.filter(F.col("p") == p.value)
        if o is not None:
            k, v, dt, lang = t.row(t.canonical(o))
            df = df.filter((F.col("k") == k) & (F.col("v") == v) & (F.col("dt") == dt) & (F.col("lang") == lang))
        return df.select(*COLUMNS)

    def properties(self, s: Term) -> dict[str, list[Term]]:
        """All objects of a subject by predicate."""
        out: dict[str, list[Term]] = {}
        for r in self.triples(s=s).collect():
            out.setdefault(r.p, []).append(of_row(r.k, r.v, r.dt, r.lang))
        return out

    def export(self, path: str | None = None, format: str | None = None, prefixes: dict[str, str] | None = None, s: Term | None = None, p: IRI | None = None, o: Term | None = None) -> int | str:
        """Writes the graph, or the triples of a pattern, to a file (returns how many) or as a string."""
        found = self.triples(s, p, o)
        return io.to_text(found, format or "ntriples", prefixes) if path is None else io.export(found, path, format, prefixes)

    # reasoning

    def materialize(self, profile: str = "owl2rl", rules: list | None = None, exclude: Iterable[str] = ()) -> dict[str, object]:
        """Derives triples by rules and keeps them; queries then see explicit and derived ones."""
        from ternion.reason import fixpoint
        from ternion.reason.rules import rules_of

        chosen = rules if rules is not None else rules_of(profile, exclude)
        began = time.time()
        with self.lock:
            result = fixpoint.materialize(forms.all_triples(self._dataset(source="explicit")), chosen)
            self.derived = TripleStore(result.derived)
            self.version += 1
            report = {"derived": result.count, "rounds": result.rounds, "seconds": round(time.time() - began, 3), "rules": [r.name for r in chosen]}
            self.status.materialized(report, profile)
        return report

    def add_with_reasoning(self, rows: Iterable[tuple[Term, IRI, Term]], profile: str = "owl2rl", rules: list | None = None, preview: bool = False) -> dict[str, int]:
        """Inserts triples and derives only what they add.  preview: tells what would be derived and changes nothing."""
        from ternion.reason import fixpoint
        from ternion.reason.rules import rules_of

        more = triples(self.spark, rows)
        with self.lock:
            derived = self.derived.df if self.derived is not None else self.store.df.limit(0)
            new = fixpoint.add(self.store.df, derived, more, rules if rules is not None else rules_of(profile))
            if not preview:
                self._commit(self.store.plus(more))
                self.derived = TripleStore(derived.unionByName(new.derived))
                self.status.materialized({"derived": new.count, "rounds": new.rounds}, profile)
        return {"derived": new.count, "rounds": new.rounds}

    def delete_with_reasoning(self, rows: Iterable[tuple[Term, IRI, Term]], profile: str = "owl2rl", rules: list | None = None, preview: bool = False) -> dict[str, int]:
        """Deletes explicit triples and the derived ones that no longer follow; preview changes nothing."""
        from ternion.reason import fixpoint
        from ternion.reason.rules import rules_of

        gone = triples(self.spark, rows)
        with self.lock:
            derived = self.derived.df if self.derived is not None else self.store.df.limit(0)
            before = derived.count()
            left = fixpoint.remove(self.store.df, derived, gone, rules if rules is not None else rules_of(profile))
            after = left.count()
            if not preview:
                self._commit(self.store.less(gone))
                self.derived = TripleStore(left)
                self.status.materialized({"derived": after}, profile)
        return {"kept": after, "lost": before - after}

    def reasoning_status(self) -> dict[str, object]:
        return self.status.as_dict()

    # operations

    def stats(self) -> dict[str, int]:
        return stats.counts(self._dataset().store or TripleStore.empty(self.spark))

    def health(self) -> dict[str, object]:
        """Whether jobs run, and what the engine holds."""
        try:
            ok = self.spark.range(1).count() == 1
        except Exception:  # a stopped session is what this is asked for
            ok = False
        return {"status": "healthy" if ok else "unhealthy", "version": self.version, "triples": sum(x.count for x in self.store.predicates.values()) if ok else None, "tables": len(self.mapping.tables) if self.mapping else 0, "reasoning": self.status.state}

    def metrics(self) -> str:
        """Counts in the text format of Prometheus."""
        health = self.health()
        rows = {"ternion_up": int(health["status"] == "healthy"), "ternion_version": self.version, "ternion_triples": health["triples"] or 0, "ternion_cached_results": len(self._results)}
        return "".join(f"# TYPE {n} gauge\n{n} {v}\n" for n, v in rows.items())

    def save(self, path: str) -> dict[str, object]:
        """Saves the explicit and derived triples as a new version under a folder."""
        name = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
        self.store.df.write.parquet(f"{path}/{name}/explicit")
        if self.derived is not None:
            self.derived.df.write.parquet(f"{path}/{name}/derived")
        n = self.store.df.count()
        # written last: a version without it is not complete
        self.spark.createDataFrame([(name, n, self.derived is not None)], "name string, triples long, derived boolean").coalesce(1).write.mode("append").parquet(f"{path}/versions")
        return {"name": name, "triples": n}

    def verify(self, path: str, name: str) -> bool:
        """Whether a saved version is complete: its triples are there and as many as were written."""
        known = {r["name"]: r for r in self.versions(path)}
        try:
            return name in known and self.spark.read.parquet(f"{path}/{name}/explicit").count() == known[name]["triples"]
        except Exception:  # missing or damaged files are what this looks for
            return False

    def rotate(self, path: str, keep: int = 5) -> list[str]:
        """Deletes all but the latest versions of a folder; returns the names of those that went."""
        rows = self.versions(path)
        gone = [r["name"] for r in rows[:-keep]] if keep else [r["name"] for r in rows]
        if gone:
            jvm, sc = self.spark._jvm, self.spark.sparkContext
            left = [tuple(r.values()) for r in rows if r["name"] not in gone]
            self.spark.createDataFrame(left, "name string, triples long, derived boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions")
            for name in gone:
                target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
                target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        return gone

    def versions(self, path: str) -> list[dict[str, object]]:
        return [r.asDict() for r in self.spark.read.parquet(f"{path}/versions").orderBy("name").collect()]

    @classmethod
    def open(cls, spark: SparkSession, path: str, name: str | None = None, **options: object) -> Engine:
        """The latest saved version of a folder, or the named one."""
        engine = cls(spark, **options)
        known = {r["name"]: r for r in engine.versions(path)}
        name = name or max(known)
        if name not in known:
            raise TernionError(f"no version {name}")
        engine.store = TripleStore(spark.read.parquet(f"{path}/{name}/explicit"))
        if known[name]["derived"]:
            engine.derived = TripleStore(spark.read.parquet(f"{path}/{name}/derived"))
        return engine


def native(sol: Solution) -> DataFrame:
    """Variables as Spark types where their kind is known, else as text."""
    from ternion.functions.values import lexical

    cols = []
    for n, info in sol.infos.items():
        value = sol.value(n)
        cols.append(F.col(n) if info.kind not in ("iri", "term") else lexical(value).alias(n))
    return sol.df.select(*cols) if cols else sol.df.select(F.lit(1).alias("_one"))


def _names(q: a.Query) -> set[str]:
    names = set(q.names) | {x.name for x in q.targets if isinstance(x, t.Var)}
    for node in a.walk(q.pattern):
        names |= a.in_scope(node)
        if isinstance(node, a.Filter):
            names |= a.references(node.condition)
        if isinstance(node, a.Extend):
            names |= a.references(node.value)
        if isinstance(node, a.LeftJoin) and node.condition is not None:
            names |= a.references(node.condition)
    return names


def _unprojected(node: object, gone: set[str]) -> object:
    """Projections without the variables that became constants."""
    node = a.rebuilt(node, lambda x: _unprojected(x, gone))
    return replace(node, names=tuple(n for n in node.names if n not in gone)) if isinstance(node, a.Project) else node


class _Watch:
    """Cancels the jobs of a block after some seconds."""

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.spark, self.seconds, self.late = spark, seconds, False

    def __enter__(self) -> bool:
        if self.seconds is None:
            return False
        self.tag = f"ternion-{uuid.uuid4().hex}"
        self.spark.sparkContext.addJobTag(self.tag)
        self.done = threading.Event()
        threading.Thread(target=self._stop, daemon=True).start()
        return True

    def _stop(self) -> None:
        # again and again: a query may be between two jobs when its time is over
        if not self.done.wait(self.seconds):
            self.late = True
            while not self.done.is_set():
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
                self.done.wait(0.2)

    def __exit__(self, kind, error, trace) -> None:
        if self.seconds is None:
            return
        self.done.set()
        self.spark.sparkContext.removeJobTag(self.tag)
        if self.late and error is not None:
            raise QueryTimeout(f"the query took more than {self.seconds} s") from None
