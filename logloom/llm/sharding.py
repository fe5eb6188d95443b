"""Sharding: weighted rendezvous hashing of stable record keys, in built-in functions only.

A record goes to the shard with the highest score `-weight / ln(u)`, where `u`
in (0, 1) comes from a hash of the record's key and the shard's number. A new
shard only takes the records for which its own score is the highest, so no
record moves between old shards.

Defined results: the key decides alone, so rows with equal keys share a shard
(a null key is a key of its own) and get different slots; an empty table gives
no rows; a null text has no bytes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in one piece of a shard, the unit within which slots are counted by a sort.
PIECE_ROWS = 4096


def unit(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that the key and the shard's number fix; 52 bits and a half are exact, so it is never 1."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that wins the key."""
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    scored = F.transform(shards, lambda s: F.struct((-s["w"] / F.ln(unit(key, s["i"]))).alias("v"), s["i"].alias("i")))
    return F.array_max(scored)["i"]


def shard_records(docs: DataFrame, weights: Sequence[float], *, grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Per row: key, size, text_crc32, shard, slot and grown_shard (the shard once `grown` holds).

    Slots are gapless from 0 in each shard. Each shard is cut into pieces by a
    hash of the key; a row's slot is the number of rows in earlier pieces of
    its shard plus its place in its own piece, so no shard is sorted as a whole.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    id_ = F.col(key)
    pieces = max(1, math.ceil(docs.count() / (PIECE_ROWS * len(weights))))
    rows = docs.select(
        id_.alias(key),
        (F.octet_length(body).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        rendezvous(id_, weights).alias("shard"),
        (rendezvous(id_, grown) if grown is not None else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(id_, F.lit("piece")), F.lit(pieces)).cast("int").alias("_piece"),
    )
    counts = (
        rows.groupBy(F.col("shard").alias("_s"), F.col("_piece").alias("_p"))
        .count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_s", "_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(id_, "size", "text_crc32")) - 1
    return (
        rows.join(counts, (F.col("shard") == F.col("_s")) & (F.col("_piece") == F.col("_p")))
        .withColumn("slot", place + F.col("_before"))
        .select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
    )
