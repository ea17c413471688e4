"""Vectorised work on the bytes of Arrow string columns.

The Python stages of this package never loop over words.  They look at the
UTF-8 buffer of a slice of documents as one numpy array, find all words of all
documents in it at once, and hash words and word windows with wrap-around
64-bit arithmetic.  A slice holds at most ``SLICE_BYTES`` of text (or one
longer document), so memory does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text that is looked at in one go.
SLICE_BYTES = 1 << 18

#: Rows and bytes of an Arrow batch between Spark and Python.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches, whose workers give their memory back when a task ends.

    The size of batches is a setting of the session, which keeps lower values it has.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(tidied, schema)


def tidy() -> None:
    """Gives unused memory of this process back to the system: idle workers otherwise keep what they once used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers.append(np.cumprod(row))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cuts a batch into runs of rows with at most ``limit`` bytes of text, or a single row."""
    _, at = buffer(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield batch.slice(first, last - first)
        first = last


def pieces(data: np.ndarray, inside: np.ndarray, limit: int = 4 * SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a long text's bytes into pieces of about ``limit`` bytes, none of which begins or ends within a word.

    inside: a table of the 256 byte values that words consist of.  A word longer than that is in one piece.
    """
    first, n = 0, len(data)
    while first < n:
        last = first + limit
        while last < n:
            gap = np.flatnonzero(~inside[data[last : last + SLICE_BYTES]])
            if len(gap):
                last += int(gap[0])
                break
            last += SLICE_BYTES
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a longest run within one row of bytes that are ``inside``."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes.  Words are hashed by stretches of text, so scratch does not grow with the text."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        first, last = starts[i:j] - base, ends[i:j] - base
        n = int(last[-1])
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        out[i:j] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _STEP)
        i = j
    return out


def _sums(values: np.ndarray, k: int, step: np.uint64) -> np.ndarray:
    """The sum of value * step ** j over the k values from each place on, put together from sums over 1, 2, 4 … values."""
    n = len(values) - k + 1
    power = lambda e: np.uint64(pow(int(step), e, 1 << 64))
    total, done, block, size = np.zeros(n, np.uint64), 0, values, 1
    while True:
        if k & size:
            total += block[done : done + n] * power(done)
            done += size
        if 2 * size > k:
            return total
        block = block[:-size] + block[size:] * power(size)
        size *= 2


def window_hashes(hashed: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether those k words lie in one row."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return mix(_sums(hashed, k, _STEP)), row[:n] == row[k - 1 :]


def window_checks(hashed: np.ndarray, k: int) -> np.ndarray:
    """32 more bits of the k words from each word on, independent of window_hashes, in the upper half of a number.

    Next to a hash and an id these are one run of bytes, which shuffles smaller than two runs.
    """
    if len(hashed) < k:
        return np.zeros(0, np.int64)
    return (mix(_sums(mix(hashed ^ _BASE), k, _INVERSE)) & np.uint64(0xFFFFFFFF00000000)).view(np.int64)


def least_of(hashed: np.ndarray, span: int) -> np.ndarray:
    """Index of the leftmost least value among the ``span`` values from each place on."""
    n = len(hashed) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, where = hashed[:n].copy(), np.zeros(n, np.int8 if span < 128 else np.int64)
    for j in range(1, span):
        lower = hashed[j : j + n] < best
        np.copyto(best, hashed[j : j + n], where=lower)
        where[lower] = j
    return np.arange(n) + where
