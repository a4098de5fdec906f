"""Sharding by jump consistent hashing, in column expressions only.

The shard follows from the key and the number of shards alone; there is no ring table, and a
further shard takes rows only into itself. Both shard numbers come from one walk: the jumps do
not depend on the number of shards, only where the walk stops does.

Defined results: rows that repeat a key share its shard; null keys count as one key; a null text
has no bytes; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.operators.ordering import numbered

# fixed values of the published algorithm
_MULTIPLIER = 2862933555777941757
_TWO_64 = 18446744073709551616
_TWO_33 = 8589934592
_TWO_31 = 2147483648.0


def _decimal(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _advanced(state: Column) -> Column:
    """Linear congruential step modulo 2**64; the product of two such numbers fits a decimal."""
    return ((state * F.lit(str(_MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"))
            % _decimal(_TWO_64)).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """``struct<shard LONG, grown LONG>``: shard of ``key`` among ``shards``, and with one more."""
    hashed = F.xxhash64(key).cast("decimal(20,0)")
    state = F.when(hashed < 0, hashed + _decimal(_TWO_64)).otherwise(hashed).cast("decimal(20,0)")

    def step(s: Column, _: Column) -> Column:
        high = F.floor(s["k"] / _decimal(_TWO_33)).cast("double")
        place = F.floor((s["grown"] + 1) * (F.lit(_TWO_31) / (high + 1))).cast("long")
        return F.when(place <= shards, F.struct(
            _advanced(s["k"]).alias("k"),
            F.when(place < shards, place).otherwise(s["shard"]).alias("shard"),
            place.alias("grown"))).otherwise(s)

    # every step that counts raises ``grown`` by one at least, so ``shards + 1`` steps are enough
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards + 1)),
        F.struct(_advanced(state).alias("k"), F.lit(0).cast("long").alias("shard"),
                 F.lit(0).cast("long").alias("grown")),
        step, lambda s: F.struct(s["shard"].alias("shard"), s["grown"].alias("grown")))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard and gapless slot of every row, and its shard once there is one shard more.

    Slots are numbered in order of ``doc_id`` over range partitions of (shard, doc_id), so no
    task holds a whole shard.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), jump(F.col("doc_id"), shards).alias("at"))
    placed = rows.select("doc_id", "size", "text_crc32", F.col("at.shard").cast("int").alias("shard"),
                         F.col("at.grown").cast("int").alias("grown_shard"))
    slots = numbered(placed, ["doc_id", "text_crc32", "size"], ["shard"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                        (F.col("slot") - 1).alias("slot"), "grown_shard")
