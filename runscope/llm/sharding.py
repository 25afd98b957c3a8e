"""Consistent sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table. Shards take turns; at its turn a shard claims the first free slot of its
order. The table has ``slots`` rows whatever the data, so it is broadcast, and
a row finds its shard by one hash and one lookup. Shards differ by at most one
slot, and a shard that leaves moves few rows besides its own.

Built-in functions only on the rows. Defined results: rows with a null key are
placed by their ``fallback`` column (null there too: by the empty string);
equal keys share a shard, so repeated rows stay together; an empty table gives
an empty table; clashing columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm.common import without

SLOTS = 8191    # prime, over a hundred slots a shard for the shards below
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _number(name: str, purpose: str) -> int:
    return int(hashlib.md5(f"{purpose}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for every slot; depends on names, not on the data."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be different names, and not more than slots")
    start = [_number(s, "start") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    turn = [0] * len(shards)
    owner = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            if not free:
                break
            while owner[slot := (start[k] + turn[k] * step[k]) % slots] >= 0:
                turn[k] += 1
            owner[slot] = k
            free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the leading 60 bits of its MD5, modulo the table size."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % slots


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """The lookup table as ``slots`` rows ``(slot, shard)``, made by the engine from one literal."""
    names = ",".join(shards[k] for k in lookup_table(shards, slots))
    return spark.range(1).select(
        F.posexplode(F.split(F.lit(names), ",")).alias("slot", "shard")
    ).select(F.col("slot").cast("long").alias("slot"), "shard")


def assign(
    df: DataFrame, key: str, fallback: str | None = None,
    shards: Sequence[str] = SHARDS, slots: int = SLOTS,
) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; no shuffle, the table of ``slots`` rows is broadcast."""
    if any("," in s for s in shards):
        raise ValueError("shard names must not hold commas")
    named = F.col(key).cast("string")
    if fallback:
        named = F.coalesce(named, F.col(fallback).cast("string"))
    placed = without(df, ["slot", "shard"]).withColumn(
        "slot", slot_of(F.coalesce(named, F.lit("")), slots))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot")


def write_shards(df: DataFrame, path: str, key: str, **options) -> None:
    """One folder per shard. Rows are spread over tasks by slot, so a large shard has many files."""
    assign(df, key, **options).repartition("slot").write.partitionBy("shard").parquet(path)


def shard_sizes(placed: DataFrame) -> DataFrame:
    """Rows and used slots of every shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"))
