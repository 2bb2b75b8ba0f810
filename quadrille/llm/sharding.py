"""Rendezvous (highest random weight) sharding of stable record keys, native only.

A key draws one uniform number per shard from a hash of both; the shard with the
greatest ``ln(u) / weight`` has the record.  A further shard can only win records,
so growth moves records into the new shard and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import free_name

#: Hex digits of a hash that are read as a number: 52 bits, exact in a double.
DRAW_DIGITS = 13


def _draw(key: Column, shard: Column) -> Column:
    """The hash of key and shard, as hex digits of fixed length (so ordered as numbers)."""
    return F.substring(F.md5(F.concat(key, F.lit("/"), shard.cast("string")).cast("binary")), 1, DRAW_DIGITS)


def rendezvous(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard (0 to shards - 1) of a string key; ties go to the smaller shard.

    ``weights``: one positive number per shard, or None for equal shards.  A null key is
    the key of the empty string."""
    if shards < 1 or (weights is not None and (len(weights) != shards or min(weights) <= 0)):
        raise ValueError("one positive weight for each of at least one shard is needed")
    key = F.coalesce(key, F.lit(""))
    scale = None if weights is None else F.array(*[F.lit(float(w)) for w in weights])

    def bid(s: Column) -> Column:
        drawn = _draw(key, s)
        if scale is not None:
            u = (F.conv(drawn, 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
            drawn = F.ln(u) / F.get(scale, s)
        return F.struct(drawn.alias("bid"), (-s).alias("s"))

    return -F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), bid))["s"]


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", weights: Sequence[float] | None = None, grown_weight: float = 1.0, slot_digits: int = 2) -> DataFrame:
    """``docs`` without its text but with size, text_crc32, law, shard, slot, grown_shard.

    * size: UTF-8 bytes of text (null: 0) plus 16; text_crc32: null for a null text;
    * grown_shard: the shard once there is one more (of ``grown_weight``);
    * slot: 0, 1, ... inside a shard, by the key's hash, then key, then text_crc32.
      Equal rows get different slots.

    A shard is numbered in 16 ** ``slot_digits`` parts whose sizes are counted first (a
    table of that many rows a shard at most, which is broadcast), so no task sorts a whole
    shard.  Only narrow columns are shuffled.
    """
    narrow = docs.select(
        F.col(key).alias("key"),
        F.col("text").cast("string").alias("text"),
    ).select(
        "key",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("k"),
    )
    k = F.col("k")
    placed = narrow.withColumn("shard", rendezvous(k, shards, weights)).withColumn("part", F.substring(F.md5(k.cast("binary")), 1, slot_digits))
    if weights is None:  # equal shards: the new one's draw against the winner's
        grown = F.when(_draw(k, F.lit(shards)) > _draw(k, F.col("shard")), F.lit(shards)).otherwise(F.col("shard"))
    else:
        grown = rendezvous(k, shards + 1, [*weights, grown_weight])
    placed = placed.withColumn("grown_shard", grown)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = "sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding)"
    starts = counts.select("shard", "part", F.coalesce(F.expr(before), F.lit(0)).alias("start"))
    rank = "row_number() over (partition by shard, part order by key, text_crc32) - 1"
    numbered = placed.withColumn("rank", F.expr(rank))
    joined = numbered.join(F.broadcast(starts), ["shard", "part"])
    return joined.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("rank")).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def with_shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", weights: Sequence[float] | None = None) -> DataFrame:
    """All columns of ``docs`` and its shard (column ``shard``, with underscores added if taken)."""
    return docs.withColumn(free_name(docs, "shard"), rendezvous(F.col(key).cast("string"), shards, weights).cast("int"))
