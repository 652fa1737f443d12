"""Sharding by a permutation-filled lookup table; DataFrame functions only on the main path."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime well over a hundred times the shards, so shares differ by under one per cent.
SLOTS = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. Shards take turns; each claims the next free slot of its own preference order.

    A preference order is offset, offset + skip, offset + 2 skip, ... modulo the prime number of
    slots, which visits every slot once. The work depends on slots alone, never on the data.
    """
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime not below the number of shards")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at, skip = {}, {}
    for i in order:
        digest = hashlib.sha256(shards[i].encode()).digest()
        at[i] = int.from_bytes(digest[:8], "big") % slots
        skip[i] = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
    table = [-1] * slots
    free = slots
    while free:
        for i in order:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): exactly `slots` rows, from one literal that the optimizer folds."""
    text = ",".join(map(str, fill_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select(
        F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))


def assign_shards(df: DataFrame, shards: list[str], id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Each row with its slot and shard; no shuffle of the rows.

    The slot is the first 15 hex digits of md5(id) modulo the slots; the table is broadcast: its
    size is the slots' number, a parameter, whatever the data. Equal ids share a shard, so null ids
    go together to the slot of the text 'null'. All other columns are left as they are; columns
    named slot or shard are replaced. An empty table gives an empty result.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    slot = F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % slots
    rows = df.drop("shard", "slot").withColumn("slot", slot)
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot").select(*[c for c in rows.columns], "shard")
