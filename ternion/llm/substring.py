"""Exact substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ternion.llm import bytewords
from ternion.llm.common import saved

#: Text that one group of documents holds on average.
BUCKET_BYTES = 4 << 20
#: Words of a window at the first level.
FIRST_WORDS = 4


def _columns(table: pa.Table):
    """For each slice of a bucket: the slice, ids, whether the id is known, word bounds, rows and hashes."""
    for part in bytewords.slices(table, "text"):
        ids = part.column("id")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        known = np.asarray(ids.is_valid())
        data, at = bytewords.buffer(part.column("text"))
        starts, ends, row = bytewords.words(data, at, ~bytewords.SPACE[data])
        yield part, np.asarray(ids.fill_null(0)), known, data, starts, ends, row, bytewords.word_hashes(data, starts, ends)


def _full(known: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
    """Where a window of that many words of one row with a known id starts."""
    n = max(0, len(row) - length + 1)
    return np.flatnonzero((row[:n] == row[len(row) - n :]) & known[row[:n]])


def _survivors(known: np.ndarray, row: np.ndarray, hashed: np.ndarray, levels: list[int], level: int, repeated: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the windows of a level that extend a repeated window of the level before.

    Every window has one anchor among the windows of the level before inside it: the leftmost with
    the least hash.  So equal windows have equal anchors, and only the anchors of a level are looked
    up there.  A window goes on if its anchor is repeated (``repeated``: sorted hashes of the level
    before; None at the first level).
    """
    at = _full(known, row, levels[-1])
    for i in range(len(levels) - 2, level - 1, -1):
        narrow, _ = bytewords.window_hashes(hashed, row, levels[i])
        at = np.unique(bytewords.least_of(narrow, levels[i + 1] - levels[i] + 1)[at])
    if level and len(at):
        narrow, _ = bytewords.window_hashes(hashed, row, levels[level - 1])
        at = at[_member((narrow >> _SPARED)[bytewords.least_of(narrow, levels[level] - levels[level - 1] + 1)[at]], repeated)]
    return at, bytewords.window_hashes(hashed, row, levels[level])[0][at]


def _grouped(hashes: list[np.ndarray], checks: list[np.ndarray], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, check) with the least id of each and whether it has more than one id."""
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    c = np.concatenate(checks) if checks else np.zeros(0, np.int64)
    d = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    if not len(h):
        return h, c, d, np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (c[order][1:] != c[order][:-1])).any():
        order = np.lexsort((c, h))
    h, c, d = h[order], c[order], d[order]
    cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    least = np.minimum.reduceat(d, cut)
    return h[cut], c[cut], least, np.maximum.reduceat(d, cut) != least


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``of``."""
    if not len(of) or not len(values):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _firsts(hashes: np.ndarray, checks: np.ndarray, answers: tuple[np.ndarray, np.ndarray, np.ndarray], none: int) -> np.ndarray:
    """The id that the answers (hashes in order, checks, ids) give for each (hash, check), or ``none``."""
    of, check, first = answers
    out = np.full(len(hashes), none, np.int64)
    if len(of):
        left, right = np.searchsorted(of, hashes), np.searchsorted(of, hashes, "right")
        for step in range(int((right - left).max(initial=0))):  # once, but where hashes clash
            at = np.minimum(left + step, len(of) - 1)
            hit = (left + step < right) & (check[at] == checks)
            out[hit] = first[at[hit]]
    return out


def _bucketed(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / bucket_bytes))
    # rows that agree in id and text are told apart by the part of the input that holds them
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(n)))


def _level(grouped, answers: DataFrame | None, make, schema: str) -> DataFrame:
    if answers is None:
        return grouped.applyInArrow(lambda left: make(left, None), schema)
    return grouped.cogroup(answers.groupBy("bucket")).applyInArrow(make, schema)


def _sorted_hashes(answers: pa.Table | None) -> np.ndarray:
    if answers is None or not answers.num_rows:
        return np.zeros(0, np.uint64)
    return np.sort(answers.column("hash").to_numpy().view(np.uint64))


def _sorted_answers(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, with their checks and first ids."""
    if not answers.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = answers.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    return h[order], answers.column("check").to_numpy()[order], answers.column("first").to_numpy()[order]


#: What a bucket asks at a level: each hash once, and whether several of its documents have the window.
_ASKS = "bucket long, hash long, many boolean"
#: At the last level with more bits of the words and the least id.
_LAST_ASKS = "bucket long, check long, hash long, least long, many boolean"
#: At the levels before, hashes lose so many bits: 48 let one in a hundred windows of 100 TB through in vain.
_SPARED = np.uint64(16)


def repeated_levels(min_words: int) -> list[int]:
    """Window lengths: 4, twice that, four times … and ``min_words`` at last: 13 gives 4, 8, 13."""
    levels, n = [], FIRST_WORDS
    while n < min_words:
        levels.append(n)
        n *= 2
    return [*levels, min_words]


def _asks(levels: list[int], level: int, last: bool):
    """What a bucket asks about the windows of a level, from the answers to the level before."""

    def run(table: pa.Table, answers: pa.Table | None) -> pa.Table:
        repeated = None if level == 0 else _sorted_hashes(answers)
        hashes, checks, ids = [], [], []
        if table.num_rows and (level == 0 or len(repeated)):
            for _p, doc, known, _d, _s, _e, row, hashed in _columns(table):
                at, found = _survivors(known, row, hashed, levels, level, repeated)
                hashes.append(found if level == len(levels) - 1 else found >> _SPARED)
                checks.append(bytewords.window_checks(hashed, levels[level])[at] if last else np.zeros(len(at), np.int64))
                ids.append(doc[row[at]])
        h, c, least, many = _grouped(hashes, checks, ids)
        made = {"bucket": np.full(len(h), table.column("bucket")[0].as_py() if table.num_rows else 0, np.int64), "check": c, "hash": h.view(np.int64), "least": least, "many": many}
        return pa.table({k: pa.array(v) for k, v in made.items() if last or k not in ("check", "least")})

    return run


def _repeated(asked: DataFrame) -> DataFrame:
    """The (bucket, hash) whose window is in several documents."""
    one = Window.partitionBy("hash")
    return asked.withColumn("n", F.count("*").over(one)).withColumn("any", F.max("many").over(one)).filter("n > 1 or any").select("bucket", "hash")


def remove_repeats(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept, spans): every text without the windows that an earlier document has.

    A window is ``min_words`` consecutive words ``[^\\x20\\x09-\\x0D]+``.  A word goes if a window
    that covers it also starts in a document with a smaller id; windows are judged on the input.
    ``kept`` has the other words, joined by one space; ``spans`` the removed runs of words as
    (first, end) word numbers.

    Levels: windows of 4 words that are in one document only are dropped; the others alone are
    extended to 8 words and looked up again, and so on to the full length.  Longer repeats consist
    of repeated windows of this length, so further doubling can't remove more; ``longest_repeats``
    goes on doubling until nothing survives.

    Documents are dealt out once into buckets of some MB.  A bucket asks about each window once, so a
    passage that a third of all documents share is one row per bucket, and at the last level the
    answer is whether an earlier id has it elsewhere, or else its least id in the bucket.  Windows are then equal if 96 bits of two hashes are: among
    the 10 ** 13 windows of 100 TB two different ones are expected to agree in less than one of a
    thousand runs.  The levels before compare 48 bits, which can only let more through.

    A null text has no words.  Rows with a null id keep all words and remove none elsewhere.  Rows
    with equal ids don't remove from each other.  Texts shorter than a window stay.  An empty table
    gives no rows; other columns are ignored.
    """
    levels = repeated_levels(min_words)
    dealt = _bucketed(docs, id_col, text_col, bucket_bytes)
    groups = lambda: dealt.groupBy("bucket")  # noqa: E731  all uses share one exchange of the texts

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _CUT.empty_table()
        told = _sorted_answers(answers)
        out = {k: [] for k in _CUT.names}
        for part, doc, known, data, starts, ends, row, hashed in _columns(table):
            marks = np.zeros(len(starts) + 1, np.int64)
            at = _full(known, row, min_words) if len(told[0]) else np.zeros(0, np.int64)
            if len(at):
                wide = bytewords.window_hashes(hashed, row, min_words)[0][at]
                hit = _member(wide, told[0])
                at, wide = at[hit], wide[hit]
                own = doc[row[at]]
                at = at[_firsts(wide, bytewords.window_checks(hashed, min_words)[at], told, np.iinfo(np.int64).max) < own]
                marks[: len(starts)] += np.bincount(at, minlength=len(starts))
                marks[min_words:] -= np.bincount(at, minlength=len(starts) + 1 - min_words)
            gone = np.cumsum(marks)[:-1] > 0
            raw, first = data.tobytes(), np.searchsorted(row, np.arange(part.num_rows + 1))
            for i in range(part.num_rows):
                a, b = first[i], first[i + 1]
                lost = gone[a:b]
                edges = np.flatnonzero(np.diff(np.r_[0, lost.astype(np.int8), 0]))
                keep = np.flatnonzero(~lost) + a
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(lost.sum()))
                out["kept"].append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode())
                out["spans"].append([{"first": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            out["id"].extend(part.column("id").to_pylist())
        return pa.table(out, schema=_CUT)

    answers = None
    for i in range(len(levels) - 1):
        answers = _repeated(_level(groups(), answers, _asks(levels, i, False), _ASKS))
    asked = _level(groups(), answers, _asks(levels, len(levels) - 1, True), _LAST_ASKS)
    # what another bucket has earlier is earlier than all here: least of all numbers, a value that shuffles small
    earliest = asked.withColumn("first", F.min("least").over(Window.partitionBy("hash", "check"))).filter("many or first < least")
    earliest = earliest.select("bucket", "check", "hash", F.when(F.col("first") < F.col("least"), F.lit(-(1 << 63))).otherwise(F.col("least")).alias("first"))
    return _level(groups(), earliest, cut, "id long, n_words long, n_removed long, kept string, spans array<struct<first:long,end:long>>")


def longest_repeats(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, longest) for every row: the greatest of the lengths ``min_words``, twice that, four times … at which another document has a window of the row's text too; 0 if none.

    Windows repeated at one length alone are extended to twice that length, until no candidates
    survive.  A window of twice the length is a candidate if both its halves are repeated.  Each
    level's repeated windows are saved, told by 64 bits.  Nulls and short texts have 0, as have rows
    with a null id.
    """
    shorter = repeated_levels(min_words)
    dealt = _bucketed(docs, id_col, text_col, bucket_bytes)

    def doubled(length: int):
        """Asks about windows of a length both halves of which are repeated."""

        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            repeated, hashes, checks, ids = _sorted_hashes(answers), [], [], []
            for _p, doc, known, _d, _s, _e, row, hashed in _columns(table):
                half, _ = bytewords.window_hashes(hashed, row, length // 2)
                again = _member(half, repeated)
                at = _full(known, row, length)
                at = at[again[at] & again[at + length // 2]]
                hashes.append(bytewords.window_hashes(hashed, row, length)[0][at])
                checks.append(np.zeros(len(at), np.int64))
                ids.append(doc[row[at]])
            h, _, _, many = _grouped(hashes, checks, ids)
            return pa.table({"bucket": pa.array(np.full(len(h), table.column("bucket")[0].as_py() if table.num_rows else 0, np.int64)), "hash": pa.array(h.view(np.int64)), "many": pa.array(many)})

        return run

    answers, levels, i = None, [], 0
    while True:
        length = shorter[i] if i < len(shorter) else 2 * length
        asked = _level(dealt.groupBy("bucket"), answers, _asks(shorter, i, False) if i < len(shorter) else doubled(length), _ASKS)
        answers = saved(_repeated(asked), "repeats")
        if answers.isEmpty():
            break
        if length >= min_words:
            levels.append(answers.withColumn("length", F.lit(length)))
        i += 1
    if not levels:
        return dealt.select("id", F.lit(0).cast("long").alias("longest"))

    def longest(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("longest", pa.int64())])
        if not table.num_rows:
            return schema.empty_table()
        lengths = answers.column("length").to_numpy() if answers.num_rows else np.zeros(0, np.int64)
        found = []
        for part in bytewords.slices(table, "text"):
            best = np.zeros(part.num_rows, np.int64)
            for _p, _doc, known, _d, _s, _e, row, hashed in _columns(part):
                for n in np.unique(lengths).tolist():
                    wide, good = bytewords.window_hashes(hashed, row, n)
                    if len(wide):
                        hit = good & known[row[: len(wide)]] & _member(wide, np.sort(answers.column("hash").to_numpy().view(np.uint64)[lengths == n]))
                        best[row[: len(wide)][hit]] = n
            found.append(pa.table([part.column("id"), pa.array(best)], schema=schema))
        return pa.concat_tables(found)

    every = levels[0]
    for level in levels[1:]:
        every = every.unionAll(level)
    return dealt.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInArrow(longest, "id long, longest long")


_CUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])
