"""Triples from a stream of N-Triples files, with reasoning kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ternion.engine import Engine
from ternion.reason import fixpoint
from ternion.reason.rules import Rule
from ternion.sources import ntriples
from ternion.sources.store import COLUMNS, TripleStore


def ingest(engine: Engine, source: str, checkpoint: str, rules: list[Rule] | None = None, once: bool = True) -> StreamingQuery:
    """Loads new files of a folder as they arrive and derives what they add.

    Each batch becomes the next version of the graph, so queries see whole batches.  A batch that is
    delivered again after a failure changes nothing, as the graph is a set.  With ``once`` the query
    ends when all files that are there have been loaded.
    """
    lines = engine.spark.readStream.text(source)

    def batch(df: DataFrame, _: int) -> None:
        more = ntriples.parse(df).dropDuplicates(COLUMNS).persist()
        with engine.lock:
            if rules:
                derived = engine.derived.df if engine.derived is not None else engine.store.df.limit(0)
                new = fixpoint.add(engine.store.df, derived, more, rules).derived
                engine.derived = TripleStore(derived.unionByName(new))
            engine._commit(engine.store.plus(more))
            if rules:
                engine.status.state = "materialized"
        more.unpersist()

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
