"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import gapless, table

#: Fixed values of the published algorithm: its linear congruential multiplier, the word size, the discarded low bits.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64
LOW = 1 << 33

#: Steps of the walk made before the rest is looked at; a walk over n shards takes about ln n + 1.
STEPS = 48

#: Rows that one numbering task gets, about.
ROWS_PER_BLOCK = 2048


def _wide(value: int) -> Column:
    return F.lit(Decimal(value))


def _state(key: Column, at: Column, to: Column) -> Column:
    return F.struct(
        key.cast("decimal(20,0)").alias("key"), at.cast("bigint").alias("at"), to.cast("bigint").alias("to")
    )


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key by jump consistent hashing.

    With one shard more, a key keeps its shard or moves to the new one. The key's 64 bits are taken as unsigned.
    A null key gives null.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        key = ((s["key"] * _wide(MULTIPLIER) + _wide(1)) % _wide(WORD)).cast("decimal(20,0)")
        high = ((key - key % _wide(LOW)) / _wide(LOW)).cast("bigint")
        to = (s["to"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))
        return F.when(s["to"] < shards, _state(key, s["to"], F.floor(to))).otherwise(s)

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    unsigned = key.cast("decimal(20,0)") + F.when(key < 0, _wide(WORD)).otherwise(_wide(0))
    first = walk(_state(unsigned, F.lit(-1), F.lit(0)), min(STEPS, shards + 1))
    if shards >= STEPS:  # the few walks that are longer go on, up to the most that there can be
        first = F.transform(F.array(first), lambda s: F.when(s["to"] < shards, walk(s, shards + 1)).otherwise(s))[0]
    return F.when(key.isNotNull(), first["at"]).cast("int")


def shard(
    frame: DataFrame, key: str, shards: int, order: list[str], rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Adds ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (the shard if there were one more).

    The key column alone, with the number of shards, decides the shard; equal keys share a shard, and rows with a null
    key share one too. ``order`` makes slots deterministic; rows equal in all its columns get slots in any order.
    An empty table gives an empty result. The frame's own columns stay as they are, in front. One with the name of an added
    column (in any case) is then there beside it, and has to be renamed before or after to be selected by name or stored.
    """
    stable = F.xxhash64(key)
    placed = frame.withColumns({"__shard": jump_hash(stable, shards), "__grown": jump_hash(stable, shards + 1)})
    blocks = max(1, ceil(frame.count() / rows_per_block))
    numbered = gapless(placed, ["__shard"], order, "__slot", blocks)
    own = [F.col(f"`{c}`") for c in frame.columns]
    return numbered.select(*own, "__shard", "__grown", "__slot").toDF(*frame.columns, "shard", "grown_shard", "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``key``."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    return shard(rows, "doc_id", 8, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
