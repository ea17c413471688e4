"""Near-duplicates by the Jaccard similarity of word shingles: the SimHash index and, for what is too far for it, min-hash bands find candidates; whole sets verify them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion.llm import bytewords, simhash
from ternion.llm.common import saved
from ternion.llm.components import components
from ternion.llm.pii import _filter_of, _in_filter

#: Words of a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bits that linked SimHashes differ in at most; at a similarity of 0.8 about 10 are expected.
BITS = 10
#: Bands of an index key each, and the min-hashes of one: a pair of similarity s shares no key with a
#: chance of (1 - s ** ROWS) ** BANDS, which is 3 in a million at 0.8.
BANDS, ROWS = 24, 4
#: Texts or sets that a task remembers to have given.
REMEMBERED = 1 << 17

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_FACTORS = bytewords.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_STEPS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


def shingles(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of each text, ordered.

    Words are those of the SimHash: A-Z lowered, parted by \\x20 and \\x09-\\x0D.  A text with fewer
    than k words has one shingle, all of it; a null or empty one has none.
    """
    data, at = bytewords.buffer(texts)
    low = _LOWERED[data]
    starts, ends, row = bytewords.words(low, at, ~bytewords.SPACE[low])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = bytewords.word_hashes(low, starts, ends)
    windows, inside = bytewords.window_hashes(hashed, row, k)
    rows, found = row[: len(windows)][inside], windows[inside]
    n = np.bincount(row, minlength=len(at) - 1)
    few = n[row] < k
    if few.any():
        short, first = np.unique(row[few], return_index=True)
        place = np.arange(few.sum()) - np.repeat(first, n[short])
        whole = bytewords.mix(np.add.reduceat(hashed[few] * _STEPS[place % 64], first) + n[short].astype(np.uint64))
        rows, found = np.r_[rows, short], np.r_[found, whole]
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])]
    return rows[new], found[new]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _keys(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The index keys of each set of shingles, one for a band."""
    out = np.zeros((len(first), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(first), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((found ^ _FACTORS[2 * i]) * (_FACTORS[2 * i + 1] | np.uint64(1)), first)
            key = bytewords.mix(key ^ least) + _FACTORS[2 * i]
        out[:, band] = key
    return out


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(id, text_hash, cls, n, keys, fp) of each row: cls tells the set of shingles (0: none), n is its size, fp is the SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a task gives the keys and SimHash of a set once, or again after many others
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                row, found = shingles(part.column("text"), k)
                cls, n = np.zeros(part.num_rows, np.uint64), np.bincount(row, minlength=part.num_rows)
                keys: list = [None] * part.num_rows
                fps: list = [None] * part.num_rows
                if len(row):
                    data, at = bytewords.buffer(part.column("text"))
                    raw = data.tobytes()
                    held, first = np.unique(row, return_index=True)
                    cls[held] = bytewords.mix(np.add.reduceat(bytewords.mix(found), first) + n[held].astype(np.uint64)) | np.uint64(1)
                    table = _keys(found, first).view(np.int64)
                    for i, r in enumerate(held.tolist()):
                        if (c := int(cls[r])) not in done:
                            done.add(c)
                            keys[r] = table[i]
                            fps[r] = simhash.signed_fingerprint(raw[at[r] : at[r + 1]], k)
                    if len(done) > REMEMBERED:
                        done.clear()
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), _signed(cls), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())], ["id", "text_hash", "cls", "n", "keys", "fp"])

    return bytewords.mapped(rows, run, "id long, text_hash long, cls long, n long, keys array<long>, fp long")


def _sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) for each of the wanted (cls, text_hash)."""
    bitmap = rows.sparkSession.sparkContext.broadcast(_filter_of(wanted.select(F.col("_hash").alias("term"))))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, done = bitmap.value, set()
        for batch in batches:
            hashes = np.asarray(batch.column("text_hash"))
            keep = _in_filter(hashes.view(np.uint64), maps)
            for i in np.flatnonzero(keep).tolist():
                keep[i] = (h := int(hashes[i])) not in done
                done.add(h)
            if len(done) > REMEMBERED:
                done.clear()
            for part in bytewords.slices(batch.filter(pa.array(keep)), "text"):
                row, found = shingles(part.column("text"), k)
                at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("text_hash"), pa.ListArray.from_arrays(pa.array(at), _signed(found))], ["text_hash", "shingles"])

    made = bytewords.mapped(rows.select("text_hash", "text"), run, "text_hash long, shingles array<long>")
    return saved(made.join(wanted, F.col("text_hash") == F.col("_hash")).select("cls", "shingles").dropDuplicates(["cls"]), "sets")


def _alike(a, b, similarity: float):
    """Sets of these sizes can be so similar at all."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are so similar."""
    one, two = (sets.select(F.col("cls").alias(f"_{c}"), F.col("shingles").alias(f"_s{c}")) for c in "ab")
    both = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    both = both.select("a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("same"), (F.size("_sa") + F.size("_sb")).alias("total"))
    return both.filter(F.col("same") >= similarity * (F.col("total") - F.col("same"))).select("a", "b")


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _indexed(each: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) of the SimHash index: the sets of one fingerprint with the least of them, and least ones along the index's links."""
    fps = saved(each.filter("fp is not null").select("fp", "cls", "n").distinct(), "fingerprints")
    least = saved(fps.groupBy("fp").agg(F.min(F.struct("cls", "n")).alias("one")), "classes")
    one, two = (least.select(F.col("fp").alias(f"_{c}"), F.col("one").alias(f"_one{c}")) for c in "ab")
    equal = fps.join(one, F.col("fp") == F.col("_a")).select(F.struct("cls", "n").alias("_onea"), F.col("_onea").alias("_oneb"))
    linked = simhash.links(least.select("fp"), BITS).join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("_onea", "_oneb")
    pairs = equal.union(linked).filter((F.col("_onea.cls") != F.col("_oneb.cls")) & _alike(F.col("_onea.n"), F.col("_oneb.n"), similarity))
    return saved(pairs.select(*_pair(F.col("_onea.cls"), F.col("_oneb.cls"))).distinct(), "pairs")


def _apart(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, cls, n, part, most): the postings of keys that hold sets of several components, each with its own and the largest one there."""
    placed = kept.select("key", "cls", "n").join(components(edges), F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("part"))
    placed = saved(placed, "placed")
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "part")).alias("most")).filter("parts > 1")
    return saved(placed.join(parts.select(F.col("key").alias("_k"), F.col("most.part").alias("most")), F.col("key") == F.col("_k")).select("key", "cls", "n", "part", "most"), "apart")


def _shared(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """The postings with c: how many of the set's shingles another of these sets has too.  No two sets here have more than the lesser c in common."""
    among = sets.join(apart.select(F.col("cls").alias("_c")).distinct(), F.col("cls") == F.col("_c"), "left_semi")
    alone = among.select("cls", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("sets"), F.min("cls").alias("_c")).filter("sets = 1")
    alone = alone.groupBy("_c").agg(F.count("*").alias("alone"))
    return saved(apart.drop("c").join(alone, F.col("cls") == F.col("_c"), "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0))).drop("_c", "alone"), "shared")


def _may(similarity: float, n, c, m, d):
    """Sets of n and m shingles, c and d of them shared with any other set, can be so similar."""
    return (F.least(n, m) >= similarity * F.greatest(n, m)) & ((1 + similarity) * F.least(c, d) >= similarity * (n + m) - 1e-6)


def links(rows: DataFrame, each: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges (a, b) between sets of at least this similarity that join all candidates which have it, directly or in steps.

    First come the candidates of the SimHash index.  A similarity of 0.8 may leave SimHashes without an
    equal byte, so that index can't be all: then every set is held against the least and the greatest
    set under each of its min-hash keys, then those
    still apart against the set of the largest component there that has the fewest shingles of its own:
    a large group of near copies grows together around its common form, in rows that grow with the
    group.  What is still apart under a key is compared, all with all but those within the largest
    component there.  Pairs whose shingles found in other sets are too few for the similarity are left
    out of that; as they need no other sets, this is done PEELS times.
    """
    postings = each.filter("keys is not null").select(F.explode("keys").alias("key"), "cls", "n")
    ends = postings.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("lo"), F.max(F.struct("cls", "n")).alias("hi")).filter("lo.cls < hi.cls").withColumnRenamed("key", "_k")
    kept = saved(postings.join(ends, F.col("key") == F.col("_k")).select("key", "cls", "n", "lo", "hi").distinct(), "postings")
    indexed = _indexed(each, similarity)
    found = kept.select("cls").union(indexed.select("a")).union(indexed.select("b")).distinct().withColumnRenamed("cls", "_c")
    wanted = saved(each.join(found, F.col("cls") == F.col("_c"), "left_semi").groupBy("cls").agg(F.min("text_hash").alias("_hash")), "wanted")
    sets = _sets(rows, wanted, k)

    star = kept.select("cls", "n", F.explode(F.array("lo", "hi")).alias("end")).filter((F.col("cls") != F.col("end.cls")) & _alike(F.col("n"), F.col("end.n"), similarity))
    star = saved(indexed.union(star.select(*_pair(F.col("cls"), F.col("end.cls")))).distinct(), "pairs")
    edges = saved(_verified(star, sets, similarity), "edges")

    apart = _shared(_apart(kept, edges), sets)
    middle = apart.filter("part = most").groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("c")).alias("alone"), "cls", "n", "c")).alias("mid")).withColumnRenamed("key", "_k")
    near = apart.filter("part <> most").join(middle, F.col("key") == F.col("_k")).filter(_may(similarity, F.col("n"), F.col("c"), F.col("mid.n"), F.col("mid.c")))
    near = saved(_untried(near.select(*_pair(F.col("cls"), F.col("mid.cls"))).distinct(), star), "pairs")
    close = saved(_verified(near, sets, similarity), "edges")
    # a component with a link to a middle set has that one's name from now on
    joined = close.select("a", "b").union(close.select("b", "a"))
    renamed = apart.filter("part <> most").join(middle, F.col("key") == F.col("_k")).select("cls", "part", F.col("mid.cls").alias("end"), "most")
    renamed = renamed.join(joined.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("cls") == F.col("_a")) & (F.col("end") == F.col("_b")))
    renamed = renamed.groupBy(F.col("part").alias("_p")).agg(F.min("most").alias("new"))
    apart = saved(apart.join(renamed, F.col("part") == F.col("_p"), "left").withColumn("part", F.coalesce("new", "part")).drop("_p", "new"), "apart")
    edges = edges.union(close)

    left, other, meet = _sides(apart, similarity)
    apart = _shared(left.join(other, meet, "left_semi"), sets)
    # each pair once, under the first key that both have
    keys = each.filter("keys is not null").join(apart.select(F.col("cls").alias("_c")).distinct(), F.col("cls") == F.col("_c"), "left_semi").dropDuplicates(["cls"]).select(F.col("cls").alias("_c"), "keys")
    apart = saved(apart.join(keys, F.col("cls") == F.col("_c")).drop("_c"), "apart")
    left, other, meet = _sides(apart.filter("part <> most"), similarity, apart)
    first = F.coalesce(*(F.when(F.get("keys", F.lit(i)) == F.get("_keys", F.lit(i)), F.get("keys", F.lit(i))) for i in range(BANDS)))
    once = (first == F.col("key")) & ((F.col("_part") == F.col("_most")) | (F.col("cls") < F.col("_cls")))
    more = left.join(other, meet & once).select(*_pair(F.col("cls"), F.col("_cls"))).distinct()
    more = saved(_untried(more, star.union(near)), "pairs")
    return edges.union(_verified(more, sets, similarity))


def _sides(apart: DataFrame, similarity: float, against: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Two sides of the postings, and the condition that a pair of different components under a key may be so similar."""
    other = apart if against is None else against
    other = other.select(*(F.col(c).alias(f"_{c}") for c in other.columns))
    return apart, other, (F.col("key") == F.col("_key")) & (F.col("part") != F.col("_part")) & _may(similarity, F.col("n"), F.col("c"), F.col("_n"), F.col("_c"))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    tried = tried.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return pairs.join(tried, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, text_hash, group, component_id) for every row of docs.

    Texts are linked if the Jaccard similarity of their sets of shingles is at least ``similarity``,
    counted over the whole sets; component_id is the least id reachable over links.  Candidates are
    found by the SimHash index, over SimHashes of as many words, and by min-hash bands (see BANDS for
    the share that these miss).  Texts with equal sets are collapsed before and given back at the end.

    Null and empty texts are one group.  A null id belongs to its component but is its least id only
    where the component has no other (then null).  Repeated rows give repeated results; an empty
    table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    each = saved(_classes(rows, shingle_words), "sets")
    roots = saved(components(links(rows, each, shingle_words, similarity)), "roots")
    classes = each.groupBy("cls").agg(F.min("id").alias("least"))
    rooted = saved(classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "least"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("cls").alias("_cls"), F.col("root").alias("group"), "component_id")
    return each.join(named, F.col("cls") == F.col("_cls")).select("id", "text_hash", "group", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their group, as simhash.representatives gives them for its links."""
    return simhash.representatives(docs, id_col, text_col, shingle_words, partial(near_duplicates, similarity=similarity))
