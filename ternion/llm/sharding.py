"""Sharding by rendezvous hashing: a record goes to the shard that scores highest for its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion.llm.common import numbered, saved

SHARDS = 40
#: What a record costs besides its text, in bytes.
OVERHEAD = 16


def shard_of(key: Column, shards: int | list[float]) -> Column:
    """The shard of a key among ``shards`` shards, numbered from 0, of equal or the given weights.

    A shard's score depends on the key and that shard alone, so another shard draws records only to
    itself, from all others alike, and a changed weight moves records only to or from its shard.
    Records fall to a shard in proportion to its weight; weight 0 gets none.
    """
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    if len(set(weights)) == 1:
        scores = [F.struct(F.xxhash64(key, F.lit(i)).alias("score"), F.lit(-i).alias("shard")) for i in range(len(weights))]
    else:
        even = lambda i: (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
        scores = [F.struct((F.lit(w) / -F.log(even(i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w]
    return -(F.greatest(*scores)["shard"] if len(scores) > 1 else scores[0]["shard"])


def shard(docs: DataFrame, shards: int | list[float] = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    The law is ``key``: the id and the number of shards decide.  ``size`` is the UTF-8 bytes of the
    text (null: none) and OVERHEAD; ``slot`` numbers a shard's records from 0 without gaps, by id,
    then text and size; ``grown_shard`` is the shard if there were one more of average weight.

    A null id is a key like any other and comes first.  A null text has CRC 0, that of no bytes.
    Rows with equal ids share a shard; repeated rows have a slot each.  An empty table gives no rows;
    other columns are ignored.  Only ids, sizes and checksums are moved, never texts; a shard's slots
    are counted by ranges of ids, so no task needs a whole shard.
    """
    more = shards + 1 if isinstance(shards, int) else [*shards, sum(shards) / max(1, len(shards))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(id_col), shards).alias("shard"),
        shard_of(F.col(id_col), more).alias("grown_shard"),
    )
    at = numbered(saved(records, "records"), ["shard", "id", "text_crc32", "size"], "slots", group="shard")
    return at.select("id", "size", "text_crc32", "law", "shard", F.col("position").alias("slot"), "grown_shard")
