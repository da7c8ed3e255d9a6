"""Placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. Shards
take turns; in a turn a shard claims the first slot of its permutation that is
still free. A key's slot is its hash modulo the table size, so placement is one
lookup, shards differ by one turn at most, and adding or removing a shard moves
few other slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots that a table may have; a broadcast table is then below 1 MB.
MOST_SLOTS = 65_537


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, skip) of a shard's permutation: slot j of it is (offset + j * skip) mod size."""
    h = hashlib.md5(shard.encode()).hexdigest()
    return int(h[:8], 16) % size, int(h[8:16], 16) % (size - 1) + 1


def lookup(shards: list[str], size: int) -> list[int]:
    """The shard number of each slot. ``size`` must be prime; names must differ."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and differ")
    if size > MOST_SLOTS or size < len(shards) or size < 3 or any(size % i == 0 for i in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime between the number of shards and MOST_SLOTS")
    table, turn, taken = [-1] * size, [0] * len(shards), 0
    prefer = [preference(s, size) for s in shards]
    while True:
        for i, (offset, skip) in enumerate(prefer):
            while table[slot := (offset + turn[i] * skip) % size] >= 0:
                turn[i] += 1
            table[slot] = i
            taken += 1
            if taken == size:
                return table


def slot_of(key: Column, size: int) -> Column:
    """The key's slot: the first 60 bits of its MD5, modulo the table size. Null counts as an empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % size).cast("long")


def assign(df: DataFrame, key: str, shards: list[str], size: int) -> DataFrame:
    """Append slot (long) and shard (string) to every row, without a shuffle.

    Only the table, at most MOST_SLOTS small rows, is broadcast. Equal keys share
    a shard; null keys are placed as the empty text. Columns named slot or shard
    are replaced. All work is in DataFrame functions.
    """
    spark: SparkSession = df.sparkSession
    rows = [(slot, shards[i]) for slot, i in enumerate(lookup(shards, size))]
    table = spark.createDataFrame(rows, "slot long, shard string")
    keyed = df.drop("shard").withColumn("slot", slot_of(df[key], size))
    return keyed.join(F.broadcast(table), "slot", "left").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")
