"""Sharding by jump consistent hashing, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the jump hash: the multiplier of its 64-bit generator, in the parts that fit without overflow.
_MULTIPLIER = 2862933555777941757
_HIGH, _MID, _LOW = _MULTIPLIER >> 32, _MULTIPLIER >> 16 & 0xFFFF, _MULTIPLIER & 0xFFFF
_WORD = 0xFFFFFFFF
#: Jumps grow as the logarithm of the number of shards; a key that needs more is walked to its end apart.
_USUAL_JUMPS = 64


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2^64, the key in two halves: no product here passes 2^63."""
    middle = low * _MID
    total = low * _LOW + F.shiftleft(middle.bitwiseAND(F.lit(_WORD)), 16) + 1
    carry = F.shiftright(total, 32) + F.shiftleft(F.shiftright(middle, 32), 16)
    upper = low * _HIGH + high * _LOW + F.shiftleft((high * _MID).bitwiseAND(F.lit(0xFFFF)), 16)
    return (carry + upper.bitwiseAND(F.lit(_WORD))).bitwiseAND(F.lit(_WORD)), total.bitwiseAND(F.lit(_WORD))


def _walk(key: Column, shards: int, jumps: int) -> Column:
    """(bucket, next) after so many jumps; a walk that has reached its end stays where it is."""

    def jump(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        bucket = state["next"]
        after = F.floor((bucket + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(high.alias("high"), low.alias("low"), bucket.alias("bucket"), after.cast("bigint").alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_WORD)).alias("low"),
        F.lit(-1).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("next"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), start, jump)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key: with one more shard a key stays or moves into the new one."""
    if shards < 1:
        raise ValueError("there must be a shard")
    usual = _walk(key, shards, min(shards, _USUAL_JUMPS))
    if shards <= _USUAL_JUMPS:
        return usual["bucket"].cast("int")
    return F.when(usual["next"] >= shards, usual["bucket"]).otherwise(_walk(key, shards, shards)["bucket"]).cast("int")


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", runs: int = 4096) -> DataFrame:
    """Per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the key (a whole number) and the number of shards decide, and one more shard takes rows only into
    itself (grown_shard). A missing key counts as -1; a missing text as empty (size 1, crc 0). Slots number the rows of
    a shard without gaps; rows with equal key and text get neighbouring slots. Repeated rows all get slots; an empty
    table gives no rows; other columns are not read.

    Slots come from two levels, so that no task holds a shard: the rows of a shard are dealt into ``runs`` by a hash of
    key and text, counted, and numbered within their run; a run starts where the runs before it end.
    """
    content = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[key].alias("k"), F.coalesce(docs[key].cast("bigint"), F.lit(-1)).alias("stable"),
        (F.octet_length(content) + 1).cast("bigint").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    rows = rows.select(
        "*", jump_hash(F.col("stable"), shards).alias("shard"), jump_hash(F.col("stable"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("stable", "text_crc32"), F.lit(runs)).alias("run"),
    )
    counts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "run").orderBy("stable", "text_crc32", "size", "k")) - 1
    return rows.withColumn("place", place).join(starts, ["shard", "run"]).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("place")).alias("slot"), "grown_shard",
    )
