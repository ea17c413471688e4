"""Benchmark decontamination by template windows with slot consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion.llm.common import saved

#: Words of a template window, share of an item's windows that a stretch of a document must have, and
#: share of slot values that must be filled consistently, from the item to the document and back.
WORDS, CONTAINED, CONSISTENT = 5, 0.8, 0.8
#: A window of an item counts if it has this many words besides placeholders.
LITERAL = 2
#: Up to this many benchmark windows (24 bytes each) are broadcast; more are joined by shuffling.  Rows are the same.
BROADCAST_WINDOWS = 200_000

#: Units that become a typed placeholder after a number.
UNITS = "milligrams? kilograms? grams? mg kg g tons? pounds? lbs? ounces? oz millimet(?:er|re)s? centimet(?:er|re)s? kilomet(?:er|re)s? met(?:er|re)s? mm cm km m inch(?:es)? feet foot ft yards? miles? seconds? minutes? hours? days? weeks? months? years? sec min hrs? ms dollars? cents? euros? usd eur gbp percent degrees? celsius fahrenheit litres? liters? ml l gallons? bytes? kb mb gb tb watts? volts? kwh mph kmh".split()

#: Fixed value: words that are never a name, however they are written.
PLAIN = "a about after all an and any are as at be because before but by can could did do does during each every find for from given had has have he her here his how i if in into is it its let many may most much must my no not of on once one or our out over she should since so some such suppose than that the their then there these they this those though through to under until up was we were what when where which while who whom whose why will with would write you your".split()

# Placeholders: a control character for each type.  A word that may be a name follows its mark; where
# values are wanted, those of numbers and units follow theirs, up to an end.
_NUMBER, _UNIT, _NAME, _END = "\x01", "\x02", "\x03", "\x04"
_NAMES = r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]*\p{Ll}[\p{L}\p{M}]*"
_NUMBERS = r"\p{Nd}+(?:[.,:/-]\p{Nd}+)*"
_MEASURES = rf"(?i)({_NUMBERS})\s*({'|'.join(UNITS)})(?!\p{{L}})"
#: What words that may be names are: themselves, or placeholders.
_READINGS = ("words", "names")


def _marked(text: Column, values: bool) -> Column:
    """The text in lower case with marks for numbers, units and capitalised words.  A text's own control characters 1 to 4 are read as marks too."""
    put = lambda mark, group: f" {mark}${group}{_END} " if values else f" {mark} "
    text = F.regexp_replace(F.coalesce(text, F.lit("")), _NAMES, f" {_NAME}$0 ")
    text = F.regexp_replace(text, _MEASURES, put(_NUMBER, 1) + put(_UNIT, 2))
    # numbers behind a mark are those that have a unit
    return F.lower(F.regexp_replace(text, rf"(?<![{_NUMBER}{_UNIT}\p{{Nd}}.,:/-]){_NUMBERS}" if values else _NUMBERS, put(_NUMBER, 0)))


def template(text: Column) -> Column:
    """The words of a text in lower case, with placeholders for numbers and units and marks before capitalised words.

    A number is a run of digits with inner separators; a unit is a unit word after a number.  Other
    signs separate words; a text that begins or ends with them has an empty word there.
    """
    return F.split(_marked(text, False), rf"[^\p{{L}}\p{{M}}{_NUMBER}-{_NAME}]+", -1)


def slots(text: Column) -> Column:
    """Like template(), with the values of numbers and units behind their marks and without empty words."""
    return F.regexp_extract_all(_marked(text, True), F.lit(rf"([{_NUMBER}{_UNIT}][^{_END}]*(?={_END})|{_NAME}?[\p{{L}}\p{{M}}]+)"), F.lit(1))


def _read(word: Column, reading: str) -> Column:
    """What a word of slots() or template() is in a reading; a capitalised word may be a name unless it is a PLAIN one."""
    mark, rest = F.substring(word, 1, 1), F.substring(word, 2, 1 << 30)
    name = rest if reading == "words" else F.when(rest.isin(PLAIN), rest).otherwise(F.lit(_NAME))
    return F.when(mark > _NAME, word).when(mark == _NAME, name).when(mark.isin(_NUMBER, _UNIT), mark).otherwise(word)


def _hashed(words: Column, reading: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(_read(w, reading)))


def _windows_of(hashed: Column, at: Column, n: int) -> Column:
    """The hash of the n words from a place on, from those of the words."""
    return F.xxhash64(F.lit(n), *(F.get(hashed, at + k) for k in range(n)))


def _each_window(df: DataFrame, words: str, lengths: list[int], values: bool) -> DataFrame:
    """(id, text_hash, at, _hash) for each place and length of a window: a row for each hash it has in the readings; with ``values`` the reading and the words there."""
    names = [f"_words{i}" for i in range(len(_READINGS))]
    df = df.select("id", "text_hash", *([words] if values else []), *(_hashed(F.col(words), r).alias(c) for r, c in zip(_READINGS, names, strict=True)))
    each = df.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(names[0]) - 1))))
    both = [(n, r, _windows_of(F.col(c), F.col("at"), n)) for n in lengths for r, c in zip(_READINGS, names, strict=True)]
    if values:
        made = F.array(*(F.struct(F.lit(r).alias("reading"), h.alias("hash"), F.slice(F.col(words), F.col("at") + 1, n).alias("values")) for n, r, h in both))
        return each.select("id", "text_hash", "at", F.explode(made).alias("w")).select("id", "text_hash", "at", F.col("w.reading").alias("_reading"), F.col("w.hash").alias("_hash"), F.col("w.values").alias("doc_values"))
    # the whole texts' words end here, before the rows are made more once again
    hashes = each.select("id", "text_hash", "at", F.array(*(h for *_, h in both)).alias("_hashes"))
    return hashes.select("id", "text_hash", "at", F.explode(F.array_distinct("_hashes")).alias("_hash"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, version, hash, place, reading, n, usual, windows, every, span, alone, values) for each window of each item and reading.

    Texts with the same id are versions of an item; equal ones count once.  Items shorter than a window are one window.  A window counts in a reading if it has
    LITERAL words or more besides placeholders; an item without such windows can't be found.
    ``usual`` tells whether the place counts with names as placeholders, ``windows`` how many do, and
    ``every`` how many count with names as words; ``span`` is the length of the stretches of a document
    that are held against the item, ``alone`` whether no other place of the item has this hash.
    """
    items = benchmark.select(F.col(id_col).alias("item"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).distinct()
    items = items.select("item", "version", slots(F.col("text")).alias("words")).filter("size(words) > 0")
    each = items.withColumn("n", F.least(F.lit(WORDS), F.size("words"))).withColumn("span", (2 * F.size("words") + 2 * WORDS).cast("long"))
    each = each.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))))
    each = each.withColumn("reading", F.explode(F.array(*(F.lit(r) for r in _READINGS)))).withColumn("values", F.slice("words", F.col("place") + 1, F.col("n")))
    literal = lambda r: F.size(F.filter("values", lambda w: _read(w, r) > _END))
    of = lambda r: F.coalesce(*(F.when(F.col("n") == k, _windows_of(_hashed(F.col("values"), r), F.lit(0), k)) for k in range(1, WORDS + 1)))
    pick = lambda f: F.when(F.col("reading") == _READINGS[0], f(_READINGS[0])).otherwise(f(_READINGS[1]))
    each = each.filter(pick(literal) >= LITERAL).withColumn("hash", pick(of)).drop("words")
    key = ["item", "version"]
    at = each.groupBy(*key, "place").agg(F.max(F.col("reading") == _READINGS[1]).alias("usual"))
    whole = at.groupBy(*key).agg(F.count_if("usual").alias("windows"), F.count("*").alias("every"))
    times = each.groupBy(*key, "hash").agg((F.countDistinct("place") == 1).alias("alone"))
    out = each
    for side, on in ((at, [*key, "place"]), (whole, key), (times, [*key, "hash"])):
        side = side.withColumnsRenamed({c: f"_{c}" for c in on})
        out = out.join(side, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on))).drop(*(f"_{c}" for c in on))
    return out


def _stretches(df: DataFrame) -> DataFrame:
    """Each hit in the two stretches it lies in; windows of a copy whose shift differs by less than half a span share one."""
    half = F.floor((F.col("at") - F.col("place")) * 2 / F.col("span"))
    return df.withColumn("stretch", F.explode(F.array(half, half + 1)))


def _enough(windows: Column, matched: Column) -> Column:
    return (windows > 0) & (matched >= CONTAINED * windows)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_hash, item, windows, matched, containment, slots, slot_agreement, verbatim) for each document that holds an item.

    A document holds an item if a stretch of it has at least CONTAINED of the item's windows, each
    with its capitalised words read as words or as names, and if the item's slots are filled
    consistently there: wherever the item repeats a value, the document repeats one too, and where the
    document repeats one, the item does, for at least CONSISTENT of the slots.  ``verbatim`` tells
    whether all values are the item's own; if not, the question was re-parameterised.

    Only documents that pass the first test are looked at again for their values.  The windows of a
    document, of all lengths in one pass, meet the benchmark's while they are made and are never
    stored; what is grouped are hits.

    Null and empty texts hold nothing, and null or empty items are never held.  Repeated documents
    and items give repeated rows (equal ones of the same id count once).  Empty tables give no rows;
    other columns are ignored.
    """
    items = saved(benchmark_windows(benchmark, item_col, item_text_col), "benchmark")
    shape = items.groupBy("n").count().collect()  # at most one row for each length up to WORDS
    lengths = sorted(r[0] for r in shape) or [WORDS]
    side = F.broadcast if sum(r[1] for r in shape) <= BROADCAST_WINDOWS else lambda df: df
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    lookup = items.select("hash", "item", "version", "place", "usual", "windows", "every", "span").distinct()
    one, total = ["id", "text_hash", "item", "version", "stretch"], ["windows", "every"]

    made = rows.select("id", "text_hash", template(F.col("text")).alias("words"))
    hits = _each_window(made, "words", lengths, False).join(side(lookup), F.col("_hash") == F.col("hash"))
    hits = _stretches(hits.select("id", "text_hash", "at", *lookup.columns[1:])).select(*one, *total, "place", "usual").distinct()
    tally = hits.groupBy(*one, *total).agg(F.count_if("usual").alias("matched"), F.count("*").alias("met"))
    held = saved(tally.filter(_enough(F.col("windows"), F.col("matched")) | _enough(F.col("every"), F.col("met"))).select("id", "text_hash").distinct(), "held")

    # the texts of the few documents that hold an item, with the values of their placeholders
    few = held.select(F.col("text_hash").alias("_few")).distinct()
    valued = rows.join(few, F.col("text_hash") == F.col("_few"), "left_semi").dropDuplicates(["id", "text_hash"]).select("id", "text_hash", slots(F.col("text")).alias("words"))
    met = _each_window(valued, "words", lengths, True).join(side(items), (F.col("_hash") == F.col("hash")) & (F.col("_reading") == F.col("reading")))
    met = saved(_stretches(met).select(*one, *total, "place", "usual", "alone", "reading", "values", "doc_values"), "met")
    tally = met.select(*one, *total, "place", "usual").distinct().groupBy(*one, *total).agg(F.count_if("usual").alias("matched"), F.count("*").alias("met"))
    usual = _enough(F.col("windows"), F.col("matched"))
    tally = tally.filter(usual | _enough(F.col("every"), F.col("met"))).select(*one, *(F.when(usual, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("windows", "every"), ("matched", "met"))))

    pairs = met.filter("alone").select(*one, "reading", F.explode(F.arrays_zip("values", "doc_values")).alias("slot")).select(*one, "reading", F.col("slot.values").alias("value"), F.col("slot.doc_values").alias("doc_value"))
    kind = F.substring("value", 1, 1)
    pairs = pairs.filter(kind.isin(_NUMBER, _UNIT) | ((kind == _NAME) & (F.col("reading") == _READINGS[1])))
    pairs = saved(pairs.groupBy(*one, "value", "doc_value").agg(F.count("*").alias("n")), "slots")
    most = None
    for i, by in enumerate(("value", "doc_value")):
        own = F.sum(F.when(F.col("value") == F.col("doc_value"), F.col("n")).otherwise(0)) if by == "value" else F.lit(0).cast("long")
        part = pairs.groupBy(*one, by).agg(F.sum("n").alias("n"), F.max("n").alias("most"), own.alias("own")).select(*one, *((F.col(c) if i == j else F.lit(0).cast("long")).alias(f"{c}{j}") for j in (0, 1) for c in ("n", "most", "own")))
        most = part if most is None else most.unionByName(part)
    filled = most.groupBy(*(F.col(c).alias(f"_{c}") for c in one)).agg(F.sum("n0").alias("slots"), F.sum("own0").alias("own"), F.least(F.sum("most0"), F.sum("most1")).alias("most"))
    found = tally.join(filled, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in one)), "left")
    found = found.withColumn("slots", F.coalesce("slots", F.lit(0))).withColumn("slot_agreement", F.when(F.col("slots") > 0, F.col("most") / F.col("slots")).otherwise(1.0)).filter(F.col("slot_agreement") >= CONSISTENT)
    # a document's best stretch speaks for it
    shown = F.struct((F.col("matched") / F.col("windows")).alias("containment"), "slot_agreement", F.coalesce(F.col("own") == F.col("slots"), F.lit(True)).alias("verbatim"), (-F.col("stretch")).alias("first"), "windows", "matched", F.col("slots").cast("long").alias("slots"))
    best = found.groupBy("id", "text_hash", "item", "version").agg(F.max(shown).alias("best"))
    return best.select("id", "text_hash", "item", *(f"best.{c}" for c in ("windows", "matched", "containment", "slots", "slot_agreement", "verbatim")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    bad = contaminated(docs, benchmark, id_col, text_col, item_col).select(F.col("id").alias("_bad_id"), F.col("text_hash").alias("_bad")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    return keyed.join(bad, (F.col("hash") == F.col("_bad")) & F.col("id").eqNullSafe(F.col("_bad_id")), "left_anti").select("row.*")
