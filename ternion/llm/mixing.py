"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion.llm.common import SPACE_CHARS, SPACE_CLASS, WORD_CLASS, n_words, numbered, saved

#: Weights of the sources in code-point order, repeating; and how often a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size), one row a source.

    The sources, by code point with null last, weigh ``weights`` in turn.  They share the sum of all
    sizes by weight; no target is above ``most_epochs`` times its source's size, and what that cuts
    off is shared by weight among the others until none is above.
    """
    at = numbered(sizes, ["source"], "sources", nulls_last=True)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("position") % len(weights) + 1).cast("int"))
    at = saved(at.select("source", "source_size", weight.cast("long").alias("weight"), (F.lit(most_epochs).cast("long") * F.col("source_size")).alias("most")), "weights")
    level, total = 0.0, at.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while total:
        # words a unit of weight gets when all that are full at the level so far stay full
        full = F.col("weight") * F.lit(level) > F.col("most")
        held, open_ = at.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (total - held) / open_
        if higher <= level:
            break
        level = higher
    return at.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most").cast("double")).alias("target"))


def _placed(docs: DataFrame, weights: tuple[int, ...], most_epochs: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, text_hash, source, size, key, position, source_size, target, passes, rest) for every row of docs.

    ``position`` counts the words before the row in its source, ``passes`` how often the whole source
    is taken, ``rest`` the words of the budget that are left for part of it.
    """
    sized = saved(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")).withColumn("key", _key(F.col("id"))), "sizes"
    )
    goal = saved(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs), "targets")
    at = numbered(sized, ["source", "key", "text_hash"], "order", group="source", weight="size", nulls_last=True)
    at = at.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    budget = F.floor("target")
    at = at.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    return at.withColumn("rest", budget - F.col("passes") * F.col("source_size"))


def _key(id_: Column) -> Column:
    return F.md5(id_.cast("string"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, text_hash, source, size, source_size, target, taken) for every row of docs.

    Each source's documents are put in the order of MD5 of their id, a random order that reruns
    repeat.  Whole passes over the source are taken as long as the budget (the target rounded down)
    has room for them, then documents in that order until the budget is used up; the last one is
    cut, so the words taken are the budget exactly.  ``taken`` counts words, repeats included.

    A null or empty text has size 0; a null source is a source of its own; null ids come last in
    their source and equal ones are ordered by their text.  A source without words takes none.  Repeated rows count each.  An
    empty table gives no rows; other columns are ignored.
    """
    at = _placed(docs, weights, most_epochs, id_col, text_col, source_col)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("position")))
    return at.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long")).select("id", "text_hash", "source", "size", "source_size", "target", "taken")


def cuts(placed: DataFrame) -> DataFrame:
    """(_source, passes, some, cut_key, cut_hash, whole, words, rows): where each source's last, partial pass ends.

    That pass (there is one where ``some``) has all rows before (cut_key, cut_hash) in the order; of
    the ``rows`` equal rows at that place ``whole`` and the first ``words`` words of one more.
    """
    last = placed.filter("size > 0 and position < rest").groupBy("source").agg(F.max(F.struct("position", "key", "text_hash")).alias("last"))
    last = last.select(F.col("source").alias("_s"), F.col("last.key").alias("cut_key"), F.col("last.text_hash").alias("cut_hash"))
    equal = placed.join(last, F.col("source").eqNullSafe(F.col("_s")) & F.col("key").eqNullSafe(F.col("cut_key")) & (F.col("text_hash") == F.col("cut_hash")))
    left = F.col("rest") - F.col("position")
    equal = equal.groupBy("source", "cut_key", "cut_hash").agg(F.max(left).alias("left"), F.max("size").alias("size"), F.count("*").alias("rows"))
    equal = equal.select("source", "cut_key", "cut_hash", F.floor(F.col("left") / F.col("size")).alias("whole"), (F.col("left") % F.col("size")).alias("words"), "rows")
    each = placed.groupBy(F.col("source").alias("_source")).agg(F.first("passes").alias("passes"))
    return saved(each.join(equal, F.col("_source").eqNullSafe(F.col("source")), "left").select("_source", "passes", F.col("rows").isNotNull().alias("some"), "cut_key", "cut_hash", "whole", "words", "rows"), "cuts")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs as the mix takes them: repeated for each pass, the cut one shortened, the others gone.

    The columns are those of docs.  A shortened text is the beginning of the text with the words
    taken, and ``chars_col`` (if docs has it) is its new length.

    A source's share is told by the place of its cut, one row a source, so whole rows stay where
    they are; only repeated rows at a cut are moved, to be numbered.
    """
    cut = cuts(_placed(docs, weights, most_epochs, id_col, text_col, source_col))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = rows.filter(F.length(F.btrim("text", F.lit(SPACE_CHARS))) > 0).withColumn("key", _key(F.col("id"))).join(cut, F.col("source").eqNullSafe(F.col("_source")))
    same = F.col("key").eqNullSafe(F.col("cut_key"))
    before = (F.col("key") < F.col("cut_key")) | (F.col("key").isNotNull() & F.col("cut_key").isNull()) | (same & (F.col("hash") < F.col("cut_hash")))
    at = F.when(~F.col("some"), 1).when(F.coalesce(before, F.lit(False)), -1).when(same & (F.col("hash") == F.col("cut_hash")), 0).otherwise(1)
    rows = rows.withColumn("at", at)
    tied = (F.col("at") == 0) & (F.col("rows") > 1)
    if cut.filter("rows > 1").isEmpty():
        rows = rows.withColumn("number", F.lit(0).cast("long"))
    else:
        some = saved(rows.filter(tied).withColumn("_tie", F.monotonically_increasing_id()), "tied")
        some = numbered(some, ["source", "_tie"], "tied", group="source").withColumnRenamed("position", "number").drop("_tie")
        rows = rows.filter(~tied).withColumn("number", F.lit(0).cast("long")).unionByName(some)
    full = F.col("passes") + ((F.col("at") < 0) | (F.col("at") == 0) & (F.col("number") < F.col("whole"))).cast("long")
    part = F.when((F.col("at") == 0) & (F.col("number") == F.col("whole")), F.col("words")).otherwise(0)
    rows = rows.select("row", full.alias("full"), part.alias("words")).withColumn("copies", F.col("full") + (F.col("words") > 0).cast("long")).filter("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    begin = F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text_col], F.lit(f"({SPACE_CLASS}*{WORD_CLASS}+)"), F.lit(1)), F.lit(1), F.col("words").cast("int")), "")
    short = F.col("copy") > F.col("full")
    new = {text_col: begin} | ({chars_col: F.length(begin).cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return rows.select(*((F.when(short, new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


#: DuckDB SQL for op8_mixing.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size / CAST(w AS DOUBLE) AS r, row_number() OVER (ORDER BY 3 * source_size / CAST(w AS DOUBLE), source) AS n,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER below, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS DOUBLE) AS level
  FROM sources
  WINDOW below AS (ORDER BY 3 * source_size / CAST(w AS DOUBLE), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT coalesce(arg_min(level, n) FILTER (WHERE level <= r), 0) AS level FROM ranked),
goal AS (
  SELECT source, source_size, least(w * chosen.level, CAST(3 * source_size AS DOUBLE)) AS target
  FROM sources, chosen),
placed AS (
  SELECT s.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""
