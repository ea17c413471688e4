"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternion.llm import bytewords
from ternion.llm.common import few_files, saved
from ternion.llm.components import components

#: Seed of XXH64 for the shingles.
SEED = 42
#: Fingerprints that share an index key are compared with each other up to this many; the keys of
#: larger groups are made finer, and what is still larger is linked by shared midpoints.
BUCKET = 256
#: Bytes from which on a text is read piece by piece.
LONG = 4 * bytewords.SLICE_BYTES
#: Bytes of a fingerprint, and how many of them two linked ones share at least: 3 bits spoil 3 bytes.
BYTES, MOST_BITS = 8, 3
SHARED = BYTES - MOST_BITS
#: Byte positions of the index keys.  Any 5 of the 8 positions hold 3 of one half, so two linked
#: fingerprints agree in at least one of these triples.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """SimHash of one text: a bit is set if it is set in over half the shingles' XXH64; no words: 0."""
    return _fingerprint((text or "").encode(), shingle_words)


def _fingerprint(raw: bytes, k: int) -> int:
    votes, total, carried = np.zeros(64, np.int64), 0, []
    data = np.frombuffer(raw, np.uint8)
    for first, last in bytewords.pieces(data, ~bytewords.SPACE) if len(raw) > LONG else [(0, len(raw))]:
        # of bytes: A-Z only, and exactly the separators \x20 \x09-\x0D
        words = carried + raw[first:last].lower().split()
        if len(words) >= k:
            votes += _votes(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
            total += len(words) - k + 1
        carried = words[max(0, len(words) - k + 1) :]
    if not total:
        if not carried:
            return 0
        votes, total = _votes([b" ".join(carried)]), 1
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def signed_fingerprint(raw: bytes, shingle_words: int) -> int:
    """The SimHash of a text's UTF-8 bytes as a signed 64-bit number."""
    fp = _fingerprint(raw, shingle_words)
    return fp - (fp >> 63 << 64)


def _votes(shingles) -> np.ndarray:
    """How many of the shingles' hashes have each bit."""
    of, seed = xxhash.xxh64_intdigest, SEED
    hashed = np.fromiter((of(p, seed) for p in shingles), np.uint64)
    votes, big = np.zeros(64, np.int64), hashed.astype(">u8").view(np.uint8).reshape(-1, 8)
    for first in range(0, len(big), 1 << 14):
        votes += np.unpackbits(big[first : first + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return votes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, text_hash, fp): the 64-bit SimHash of every whole text as a signed long.  A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                data, at = bytewords.buffer(part.column("text"))
                raw = data.tobytes()
                fps = np.fromiter((_fingerprint(raw[at[i] : at[i + 1]], shingle_words) for i in range(len(at) - 1)), np.uint64, len(at) - 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(fps.view(np.int64))], ["id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return bytewords.mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), run, "id long, text_hash long, fp long")


def _tree(fps: np.ndarray, most: int = MOST_BITS) -> Iterator[tuple[int, int]]:
    """Links that join what is within so many bits among fps (at most BUCKET of one key): no more than fps less one."""
    octets = fps.view(np.uint8).reshape(-1, 8)
    tally = (octets[:, None, :] == octets[None, :, :]).sum(axis=2)  # shared positional bytes of each pair
    a, b = np.nonzero(np.triu(tally >= max(len(TRIPLES[0]), BYTES - most), 1))
    differ = np.bitwise_count(fps[a] ^ fps[b])
    near = differ <= most
    if most > MOST_BITS:  # the closest first, as a further check holds for them sooner
        near = np.argsort(differ, kind="stable")[: near.sum()]
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            root[q] = p
            yield int(fps[x]), int(fps[y])


def _edges_of_buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[int, int]] = []
        for bucket in batch.column("fps"):
            found.extend(_tree(np.unique(np.asarray(bucket.values).view(np.uint64)), most))
        a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _octet(position: int):
    return F.shiftrightunsigned("fp", 8 * (BYTES - 1 - position)).bitwiseAND(F.lit(255).cast("long"))


def _key(table: int, positions: tuple[int, ...]):
    """The index key of a fingerprint: which positions, then the bytes there."""
    key = F.lit(table).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_octet(p))
    return key


def _index(fps: DataFrame, tables: list[tuple[int, ...]]) -> DataFrame:
    """A posting (key, fp) for each fingerprint and table."""
    return fps.select("fp", F.explode(F.array(*(_key(i, t) for i, t in enumerate(tables)))).alias("key"))


def _small_and_large(postings: DataFrame, name: str, most: int, files: int | None) -> tuple[DataFrame, DataFrame]:
    """Links within keys of 2 to BUCKET fingerprints, and the postings of larger keys."""
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "_k")
    kept = postings.join(sizes, F.col("key") == F.col("_k")).select("key", "fp", "n")
    kept = saved(kept if files is None else kept.repartition(files), name)  # dealt anew, as one task is not to sort for many partitions of the join
    buckets = kept.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    return bytewords.mapped(buckets, partial(_edges_of_buckets, most=most), "a long, b long"), kept.filter(F.col("n") > BUCKET)


def _midpoint_links(large: DataFrame) -> DataFrame:
    """Links within over-full five-byte keys, in rows that grow with the fingerprints and not with their pairs.

    Two fingerprints within 3 bits have a midpoint within 1 bit of one and 2 bits of the other.  For
    each fingerprint its 1 + 24 + 276 midpoints over the 24 bits outside the key are listed; at each
    midpoint all fingerprints within 1 bit (they are within 2 bits of each other) and, if there are
    such, those within 2 bits are tied to the least one within 1 bit.
    """
    tables = list(combinations(range(BYTES), SHARED))
    free = {i: [1 << (8 * (BYTES - 1 - p) + bit) for p in range(BYTES) if p not in t for bit in range(8)] for i, t in enumerate(tables)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                fps, keys = (np.asarray(part.column(c)) for c in ("fp", "key"))
                masks = []
                for key in keys.tolist():
                    bits = free[key >> (8 * SHARED)]
                    masks.append([0, *bits, *(x ^ y for x, y in combinations(bits, 2))])
                mids = (fps.view(np.uint64)[:, None] ^ np.array(masks, np.uint64)).view(np.int64)
                width = mids.shape[1]
                far = np.repeat([0, 0, 1], [1, 24, width - 25]).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, width)), pa.array(mids.ravel()), pa.array(np.repeat(fps, width)), pa.array(np.tile(far, len(fps)))], ["key", "mid", "fp", "far"])

    around = bytewords.mapped(large.select("key", "fp"), run, "key long, mid long, fp long, far boolean")
    centre = around.groupBy("key", "mid").agg(F.min(F.when(~F.col("far"), F.col("fp"))).alias("c"), F.count("*").alias("n")).filter("n > 1 and c is not null")
    centre = centre.select(F.col("key").alias("_k"), F.col("mid").alias("_m"), "c")
    return around.join(centre, (F.col("key") == F.col("_k")) & (F.col("mid") == F.col("_m"))).filter("fp <> c").select(F.col("c").alias("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, most: int = MOST_BITS, files: int | None = None) -> DataFrame:
    """Edges (a, b) that join all fingerprints within 3 bits of each other, directly or in steps of at most 3 bits.

    fps has distinct values in column fp.  Every edge holds; edges that others imply may be missing.
    With a larger ``most`` edges of up to that many bits join those that share three bytes of one half
    too, where at most BUCKET fingerprints do; other pairs of over 3 bits may be missing.
    Postings are saved in as many ``files``; unset, in one for each partition.
    """
    edges, large = _small_and_large(_index(fps, TRIPLES), "postings", most, files)
    if large.isEmpty():
        return edges
    # two linked fingerprints of an over-full triple still share 5 positions: index those alone by all 56 choices
    finer, larger = _small_and_large(_index(large.select("fp").distinct(), list(combinations(range(BYTES), SHARED))), "postings", most, files)
    edges = edges.union(finer)
    return edges if larger.isEmpty() else edges.union(_midpoint_links(larger))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, text_hash, fp, group, component_id) for every row of docs.

    group is the least fingerprint of the component; component_id is the least id reachable over links of at most 3 differing bits, itself included.
    Equal fingerprints are collapsed before the index and given back at the end, so a group of
    copies costs one posting per key however large it is.

    Null or empty texts have fingerprint 0 and are linked like any other.  A null id belongs to
    its component but is its least id only where the component has no other (then null).
    Repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    each = saved(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes, files = each.groupBy("fp").agg(F.min("id").alias("least")), few_files(each)
    fps = saved(classes.select("fp").coalesce(files), "classes")
    roots = saved(components(links(fps, files=files), files).coalesce(files), "roots")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), F.col("root").alias("group"), "component_id")
    return each.join(named, F.col("fp") == F.col("_fp")).select("id", "text_hash", "fp", "group", "component_id")


def hex_fingerprint(fp):
    """16 lower-case hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, near: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group: one row for each component of ``near``.

    That is the row with the component's least id; a null id counts as the largest.  Of several rows
    with that id (repeated ones, or different texts in one component) the one with the least hash stays.
    """
    last = (1 << 63) - 1
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = near(keyed, "id", "text", shingle_words).filter("id = component_id").groupBy("group").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    found = found.select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    rows = keyed.withColumn("hash", F.xxhash64("text")).join(found, (F.col("id") == F.col("_id")) & (F.col("hash") == F.col("_hash")))
    number = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1)))
    return rows.withColumn("number", number).filter("number = 1").select("row.*")
