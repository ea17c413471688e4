"""Document fingerprints: digests of statistically improbable byte features.

Byte windows are ranked by how rare their entropy is in the corpus; in each neighbourhood the
rarest window stands out, and windows that stand out often are the features.  A feature sets five
bits of a Bloom filter; a filter takes a fixed number of features, then the next one is begun.  Two
digests are compared filter by filter through the bits they share beyond chance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ternion.llm import bytewords

#: Bytes of a feature; neighbouring windows among which one stands out; times it must.
WINDOW, SPAN, POPULAR = 32, 32, 8
#: Bytes of the features of texts that have no full neighbourhood.
SHORT = 8
#: Bits and features of a Bloom filter, and bits that a feature sets.
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 160, 5
#: Shared bits up to this part of the way from chance to equality count as none.
CHANCE = 0.1
#: Steps of a bit in which entropy is counted, and the entropy under which a window is no feature.
STEPS, LEAST_ENTROPY = 200, 1.0
#: Text of one range of documents.
RANGE_BYTES = 8 << 20

_LAST = np.int64(1) << 40  # rank beyond all windows that may be features
_counts = np.arange(WINDOW + 1)
_NLOGN = np.round(_counts * np.log2(np.maximum(_counts, 1)) * 65536).astype(np.int64)
_GAIN = np.diff(_NLOGN)  # what one more byte of a value adds to the sum of n log n


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy in 1/STEPS bit of each window of WINDOW bytes.

    The sum of n log n over byte counts is carried along: a byte that enters adds by how many
    equal bytes are among the WINDOW - 1 before it, one that leaves takes by those after it.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for first in range(0, n, 1 << 16):  # what fits into the processor's cache
        last = min(n, first + (1 << 16))
        for k in range(1, WINDOW):
            lo = max(first, k)
            same = data[lo:last] == data[lo - k : last - k]
            back[lo:last] += same
            ahead[lo - k : last - k] += same
    total = np.cumsum(_GAIN[back])
    total[WINDOW:] -= np.cumsum(_GAIN[ahead])[: n - WINDOW]
    sums = total[WINDOW - 1 :]
    return np.round((math.log2(WINDOW) - sums / (65536 * WINDOW)) * STEPS).astype(np.int64)


def _valid(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether the ``width`` bytes from each place on lie in one row."""
    ok = np.ones(max(0, n - width + 1), bool)
    for cut in at[1:-1].tolist():
        ok[max(0, cut - width + 1) : cut] = False
    return ok


def entropy_counts(docs: DataFrame, text_col: str = "text") -> tuple[dict[int, int], int]:
    """How many windows of all whole texts have each entropy, and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(int(STEPS * math.log2(WINDOW)) + 2, np.int64)
        size = 0
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                data, at = bytewords.buffer(part.column("text"))
                size += len(data)
                bins = entropy_bins(data)
                counts += np.bincount(bins[_valid(at, len(data), WINDOW)], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen]), pa.array(np.r_[size, counts[seen]])], ["bin", "n"])

    found = bytewords.mapped(docs.select(F.col(text_col).alias("text")), run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    counts = {r.bin: r.n for r in found.collect()}  # about a thousand rows at most
    return counts, counts.pop(-1, 0)


def rarity_ranks(counts: dict[int, int]) -> np.ndarray:
    """Rank of each entropy: the rarer in the corpus, the lower.  Too low entropies rank last."""
    size = int(STEPS * math.log2(WINDOW)) + 2
    order = sorted(range(size), key=lambda b: (counts.get(b, 0), b))
    ranks = np.zeros(size, np.int64)
    ranks[order] = np.arange(size)
    ranks[: int(LEAST_ENTROPY * STEPS)] = _LAST
    return ranks


def features(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each feature, by row and place; a row's equal features count once.

    In a row too short for a neighbourhood every window of SHORT bytes is one.  A row that is not
    empty and still has none gets its whole content as one.
    """
    n, rows, found = len(data), [], []
    bins = entropy_bins(data)
    row_of = lambda x: np.searchsorted(at, x, "right") - 1
    if len(bins):
        rank = np.where(_valid(at, n, WINDOW), ranks[bins], _LAST << 1)
        key = (rank << np.int64(20)) + 0
        index = np.arange(len(key))
        # leftmost least rank among SPAN windows, by doubling; places are kept beside the ranks
        best, where, width = key, index, 1
        while width < SPAN and len(best) > width:
            right = best[width:] < best[:-width]
            where = np.where(right, where[width:], where[:-width])
            best = np.minimum(best[width:], best[:-width])
            width *= 2
        picked: list[np.ndarray] = []
        if width == SPAN and len(best):
            whole = _valid(at, n, WINDOW + SPAN - 1) & (best < _LAST << np.int64(20))
            places, times = np.unique(where[whole], return_counts=True)
            spans = np.diff(at) - (WINDOW + SPAN - 2)
            picked.append(places[times >= np.clip(spans[row_of(places)] // 8, 1, POPULAR)])
        places = np.sort(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
        if len(places):
            lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places]).view("<u8").astype(np.uint64)
            h = np.full(len(places), 0x9E3779B97F4A7C15, np.uint64)
            for j in range(lanes.shape[1]):
                h = bytewords.mix(h ^ lanes[:, j]) + np.uint64(j + 1)
            rows.append(row_of(places))
            found.append(bytewords.mix(h))
    # rows too short for a neighbourhood: every window of SHORT bytes is a feature
    brief = np.flatnonzero((np.diff(at) >= SHORT) & (np.diff(at) < WINDOW + SPAN - 1))
    if len(brief):
        places = np.concatenate([np.arange(at[i], at[i + 1] - SHORT + 1) for i in brief.tolist()])
        lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SHORT)[places]).view("<u8")[:, 0]
        rows.append(row_of(places))
        found.append(bytewords.mix(lanes.astype(np.uint64)))
    have = np.zeros(len(at) - 1, bool)
    for row in rows:
        have[row] = True
    bare = np.flatnonzero(~have & (np.diff(at) > 0))
    if len(bare):
        rows.append(bare)
        raw = data.tobytes()
        found.append(np.array([int.from_bytes(hashlib.blake2b(raw[at[i] : at[i + 1]], digest_size=8).digest(), "big") for i in bare.tolist()], np.uint64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((np.arange(len(h)), h, row))
    first = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])]]
    first = first[np.lexsort((first, row[first]))]
    return row[first], h[first]


def digests(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """For each row its chain of Bloom filters, as an array of filters by bytes."""
    row, h = features(data, at, ranks)
    n = len(at) - 1
    count = np.bincount(row, minlength=n)
    filters = -(-count // FILTER_FEATURES)
    base = np.r_[0, np.cumsum(filters)]
    begin = np.r_[0, np.cumsum(count)]
    which = base[row] + (np.arange(len(row)) - begin[row]) // FILTER_FEATURES
    bits = np.zeros((base[-1], FILTER_BITS), bool)
    for j in range(FEATURE_BITS):
        bits[which, (h >> np.uint64(11 * j)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[base[i] : base[i + 1]] for i in range(n)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of two digests' bits that the other one has too, beyond chance.

    Each filter counts with its best match in the other chain, weighted by its bits, both ways.
    Two empty digests are alike; an empty one is unlike any other.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    pa_, pb = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    wide_b = b.view(np.uint64)
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    step = max(1, (1 << 20) // (32 * len(b)))
    for first in range(0, len(a), step):
        part = a[first : first + step].view(np.uint64)
        shared = np.bitwise_count(part[:, None, :] & wide_b[None, :, :]).sum(axis=2, dtype=np.int64)
        own = pa_[first : first + step, None]
        most, least = np.minimum(own, pb[None, :]), own * pb[None, :] / FILTER_BITS
        floor = least + CHANCE * (most - least)
        share = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1) * most
        best_a[first : first + step] = (share / own).max(axis=1)
        best_b = np.maximum(best_b, (share / pb[None, :]).max(axis=0))
    return float(((best_a * pa_).sum() + (best_b * pb).sum()) / (pa_.sum() + pb.sum()))


def as_text(filters: np.ndarray) -> str:
    return filters.tobytes().hex()


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): the digest of every whole text in hex, with the given or the corpus's own ranks."""
    if ranks is None:
        ranks = rarity_ranks(entropy_counts(docs, text_col)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                found = digests(*bytewords.buffer(part.column("text")), ranks)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([as_text(x) for x in found], pa.string())], ["id", "fingerprint"])

    return bytewords.mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, fingerprint string")


_NO_ID = -(1 << 63)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as
    many of the next document by ascending id; after the last comes the first.  Returns (id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents are dealt out by ranges of their ids; each range also gets the first document of the
    following one, so that a stream over a range sees every document with its next.  The texts move
    once.  A null text counts as empty.  Null ids come first; equal ids are ordered by text, and
    repeated rows each have a result.  A single document is its own next.  An empty table gives no rows.
    """
    counts, size = entropy_counts(docs, text_col)
    ranks = rarity_ranks(counts)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, math.ceil(size / range_bytes))
    bounds = np.zeros(0, np.int64)
    if n > 1:
        at = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000)).first()[0]
        bounds = np.unique(np.array(at, np.int64))

    @F.pandas_udf(LongType())
    def part_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int64))

    heads = dict(rows.select(part_of("key").alias("p"), "key").groupBy("p").agg(F.min("key")).collect())  # one row for each range
    firsts = sorted(heads)
    before = {heads[p]: firsts[i - 1] for i, p in enumerate(firsts)}  # the range that looks ahead at a head

    @F.pandas_udf("array<long>")
    def places(key):
        import pandas as pd

        own = np.searchsorted(bounds, key.to_numpy(), "right").tolist()
        return pd.Series([[2 * p, 2 * before[k] + 1] if k in before else [2 * p] for p, k in zip(own, key.tolist(), strict=True)])

    dealt = rows.select("id", "key", "text", F.explode(places("key")).alias("place"))
    dealt = dealt.withColumn("part", F.shiftright("place", 1)).repartition("part").sortWithinPartitions("part", "place", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its place, id, text and digest
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                place, ids, texts = part.column("place").to_pylist(), part.column("id").to_pylist(), part.column("text").to_pylist()
                found = digests(*bytewords.buffer(part.column("text")), ranks)
                new = list(zip(place, ids, texts, found, strict=True))
                pairs = list(zip([held, *new[:-1]] if held else new[:-1], new if held else new[1:], strict=True))
                held = new[-1]
                pairs = [(a, b) for a, b in pairs if not a[0] & 1 and a[0] >> 1 == b[0] >> 1]
                if not pairs:
                    continue
                edited = [(a[2][: len(a[2]) - len(a[2]) // 4] + b[2][: len(a[2]) // 4]).encode() for a, b in pairs]
                changed: list[np.ndarray] = []
                first = 0
                while first < len(edited):
                    last, total = first, 0
                    while last < len(edited) and (last == first or total + len(edited[last]) <= bytewords.SLICE_BYTES):
                        total += len(edited[last])
                        last += 1
                    joined = np.frombuffer(b"".join(edited[first:last]), np.uint8)
                    changed += digests(joined, np.r_[0, np.cumsum([len(x) for x in edited[first:last]])].astype(np.int64), ranks)
                    first = last
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[1] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                        pa.array([as_text(a[3]) for a, _ in pairs], pa.string()),
                        pa.array([as_text(x) for x in changed], pa.string()),
                        pa.array([likeness(a[3], x) for (a, _), x in zip(pairs, changed, strict=True)], pa.float64()),
                        pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                    ],
                    ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return bytewords.mapped(dealt.select("id", "text", "place"), run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
