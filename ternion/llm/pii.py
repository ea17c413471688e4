"""Personal data: patterns, then terms that reveal the entities found, by corpus co-occurrence."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternion.llm import bytewords
from ternion.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that may reveal it.
CONTEXT = 5
#: A term reveals an entity if they meet in at least MEETINGS different texts, if knowing the term
#: leaves at most RESIDUE bits of surprise about the entity, and if that takes away at least the share
#: DISCLOSURE of the entity's self-information.
MEETINGS, RESIDUE, DISCLOSURE = 2, 1.0, 0.5
#: A revealing term seen with at least this many entities is generalised, others are removed.
GENERALISE = 3
#: Bits of the filter that picks the words worth counting.
FILTER_BITS = 1 << 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SKIP = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches in a text, by kind, then start, in code points.

    Matches are leftmost and don't overlap within a kind; those that fail their test are dropped and
    not tried again from another place.  Runs of characters are scanned once, so long ones cost no
    more than their length.
    """
    spans = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return spans
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _SKIP.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_SKIP.sub("", m[0])) <= 15]
    return spans


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_WORD = re.compile(r"\w+")
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def _terms(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds and hashes of a text's terms: runs of ASCII letters, digits, _ and other bytes, A-Z lowered."""
    data = np.frombuffer(raw, np.uint8)
    low = _LOWERED[data]
    starts, ends, _ = bytewords.words(low, np.array([0, len(low)]), _TOKEN[low])
    return starts, ends, bytewords.word_hashes(low, starts, ends)


def _entity_hash(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value.lower()}".encode(), digest_size=8).digest(), "big", signed=True)


def _near(raw: bytes, text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(entity, term) for each term near each entity."""
    starts, ends, hashed = _terms(raw)
    plain = len(raw) == len(text)
    for kind, s, e in spans:
        a, b = (s, e) if plain else (len(text[:s].encode()), len(text[:e].encode()))
        left = int(np.searchsorted(ends, a, "right"))
        right = int(np.searchsorted(starts, b, "left"))
        entity = _entity_hash(kind, text[s:e])
        for t in np.unique(np.r_[hashed[max(0, left - CONTEXT) : left], hashed[right : right + CONTEXT]]).tolist():
            yield entity, t


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def meetings(docs: DataFrame) -> DataFrame:
    """(entity, term, texts, entity_texts): in how many different texts a term stands near an entity (MEETINGS at least), and how many have the entity.  docs: text_hash, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                rows: set[tuple[int, int, int]] = set()
                for own, text in zip(part.column("text_hash").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text and (spans := base_spans(text)):
                        rows.update((*x, own) for x in _near(text.encode(), text, spans))
                e, t, h = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), _signed(t), pa.array(h, pa.int64())], ["entity", "term", "text_hash"])

    near = bytewords.mapped(docs.select("text_hash", "text"), run, "entity long, term long, text_hash long")
    each = saved(near.distinct(), "near")
    pairs = each.groupBy("entity", "term").agg(F.count("*").alias("texts")).filter(F.col("texts") >= MEETINGS)
    whole = each.select("entity", "text_hash").distinct().groupBy(F.col("entity").alias("_entity")).agg(F.count("*").alias("entity_texts")).filter(F.col("entity_texts") >= MEETINGS)
    return pairs.join(whole, F.col("entity") == F.col("_entity")).drop("_entity")


def _filter_of(terms: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of fixed size with the bit of each term set: words whose bit is not set are none of them."""
    found = terms.select(F.shiftrightunsigned("term", 40).alias("slot")).distinct()
    words = found.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask"))
    bitmap = np.zeros(bits // 64, np.uint64)
    for r in words.collect():  # at most bits / 64 rows
        bitmap[r.word] = r.mask & 0xFFFFFFFFFFFFFFFF
    return bitmap


def _in_filter(hashed: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = hashed >> np.uint64(40)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def revealing(docs: DataFrame) -> DataFrame:
    """(term, entities, disclosure) for the terms that reveal protected entities.  docs: text_hash, text.

    All counts are of different texts, so copies of a text neither reveal nor hide.  An entity in n of
    N texts has the self-information log2((N + 1) / n), leaving room for an unseen text; a term that
    is in m texts, t of them with the entity near it, leaves log2(m / t) bits of that.  disclosure is
    the share that the term takes away: the pointwise mutual information of the two over the
    self-information.  See MEETINGS for the thresholds.
    """
    met = saved(meetings(docs), "meetings")
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_filter_of(met))  # of fixed size
    if met.isEmpty():
        return spark.createDataFrame([], "term long, entities long, disclosure double")
    texts = saved(docs.groupBy("text_hash").agg(F.count("*").alias("n")), "texts")
    n_texts = texts.count()
    copied = texts.filter("n > 1").select(F.col("text_hash").alias("term"))
    copies = spark.sparkContext.broadcast(_filter_of(copied))  # of fixed size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terms with the number of texts that have no copies, and (term, text) of those that may have some."""
        maps, twice = bitmap.value, copies.value
        held, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        done: set[int] = set()  # texts with copies that this task has given

        def merged() -> tuple[np.ndarray, np.ndarray]:
            terms, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return terms, np.bincount(back, np.concatenate([n for _, n in held]), len(terms)).astype(np.int64)

        for batch in batches:
            hashes = np.asarray(batch.column("text_hash"))
            maybe, keep = _in_filter(hashes.view(np.uint64), twice), np.ones(len(hashes), bool)
            for i in np.flatnonzero(maybe).tolist():
                keep[i] = (h := int(hashes[i])) not in done
                done.add(h)
            if len(done) > 1 << 17:
                done.clear()
            for part in bytewords.slices(batch.filter(pa.array(keep)), "text"):
                data, at = bytewords.buffer(part.column("text"))
                low = _LOWERED[data]
                starts, ends, row = bytewords.words(low, at, _TOKEN[low])
                hashed = bytewords.word_hashes(low, starts, ends)
                hit = _in_filter(hashed, maps)
                pairs = np.unique(np.column_stack([hashed[hit], row[hit].astype(np.uint64)]), axis=0)
                own = np.asarray(part.column("text_hash"))
                shared = _in_filter(own.view(np.uint64), twice)[pairs[:, 1].astype(np.int64)]
                if shared.any():
                    some = pairs[shared]
                    yield pa.RecordBatch.from_arrays([_signed(some[:, 0]), pa.array(own[some[:, 1].astype(np.int64)]), pa.array(np.ones(len(some), np.int64))], ["term", "text_hash", "n"])
                held.append(np.unique(pairs[~shared, 0], return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 20:  # a task gives each term once, however much text it reads
                    held[:] = [merged()]
                    size = len(held[0][0])
        terms, n = merged()
        yield pa.RecordBatch.from_arrays([_signed(terms), pa.nulls(len(terms), pa.int64()), pa.array(n)], ["term", "text_hash", "n"])

    # a text with copies counts once, whichever tasks gave it; those without are told by no hash
    given = bytewords.mapped(docs.select("text_hash", "text"), counted, "term long, text_hash long, n long")
    once = given.groupBy("term", "text_hash").agg(F.when(F.col("text_hash").isNull(), F.sum("n")).otherwise(1).alias("n"))
    seen = once.groupBy("term").agg(F.sum("n").alias("seen")).withColumnRenamed("term", "_term")
    left, whole = F.log2(F.col("seen") / F.col("texts")), F.log2(F.lit(n_texts + 1.0) / F.col("entity_texts"))
    both = met.join(seen, F.col("term") == F.col("_term")).withColumn("disclosure", 1 - left / whole)
    telling = both.filter((left <= RESIDUE) & (F.col("disclosure") >= DISCLOSURE))
    return saved(telling.groupBy("term").agg(F.count("*").alias("entities"), F.max("disclosure").alias("disclosure")), "revealing")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, base, terms) for every row of docs: base spans and spans of revealing terms.

    base and terms are arrays of (kind, start, end) in code points, end exclusive, each in order;
    the kind of a term is ``generalise`` if it was met with several entities, else ``remove``.

    A null text counts as empty and has none.  Null ids and repeated rows are handled like others
    (rows that agree in id and text are looked at once and returned each).  An empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    telling = revealing(rows)
    bitmap = docs.sparkSession.sparkContext.broadcast(_filter_of(telling))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = bitmap.value
        some = bool(maps.any())
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                base, maybe = [], []
                for text in part.column("text").to_pylist():
                    spans = base_spans(text)
                    base.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans])
                    words: list[dict] = []
                    if some and text:
                        raw = text.encode()
                        starts, ends, hashed = _terms(raw)
                        inside = sorted((s, e) for _, s, e in spans)
                        for i in np.flatnonzero(_in_filter(hashed, maps)).tolist():
                            s, e = (int(starts[i]), int(ends[i])) if len(raw) == len(text) else (len(raw[: starts[i]].decode()), len(raw[: ends[i]].decode()))
                            if not any(a < e and s < b for a, b in inside):
                                words.append({"term": int(hashed[i : i + 1].view(np.int64)[0]), "start": s, "end": e})
                    maybe.append(words)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(base, _BASE), pa.array(maybe, _MAYBE)], ["id", "text_hash", "base", "maybe"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    found = bytewords.mapped(rows, run, f"id long, text_hash long, base {spans}, maybe array<struct<term:long,start:long,end:long>>")
    if telling.isEmpty():
        return found.select("id", "text_hash", "base", F.array().cast(spans).alias("terms"))
    found = saved(found, "spans")
    hits = found.filter(F.size("maybe") > 0).select("id", "text_hash", F.explode("maybe").alias("m")).distinct()
    hits = hits.join(telling.withColumnRenamed("term", "_term"), F.col("m.term") == F.col("_term"))
    span = F.struct(F.when(F.col("entities") >= GENERALISE, "generalise").otherwise("remove").alias("kind"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    terms = hits.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(span).alias("terms"))  # of one text
    terms = terms.withColumn("terms", F.array_sort("terms", lambda a, b: (F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))))
    both = found.join(terms, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return both.select("id", "text_hash", "base", F.coalesce("terms", F.array().cast(spans)).alias("terms"))


_SPAN = [("start", pa.int64()), ("end", pa.int64())]
_BASE = pa.list_(pa.struct([("kind", pa.string()), *_SPAN]))
_MAYBE = pa.list_(pa.struct([("term", pa.int64()), *_SPAN]))


def _redacted(text: str | None, spans: list) -> str | None:
    if text is None:
        return None
    out, done = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], "" if s["kind"] == "remove" else "[TERM]" if s["kind"] == "generalise" else f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with entities replaced by their kind, revealing terms generalised or removed.

    Texts without any keep as they are, null ones too; all columns and rows are returned.
    """
    found = find(docs, id_col, text_col).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.concat("base", "terms").alias("_spans")).filter(F.size("_spans") > 0).distinct()

    @F.arrow_udf("string")
    def redact(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array((_redacted(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)), pa.string())

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    new = redact("text", F.coalesce("_spans", F.array().cast("array<struct<kind:string,start:long,end:long>>")))
    return both.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
