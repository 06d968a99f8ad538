"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has a preference order of the slots 0 .. size-1, a walk (offset + k * skip) mod size over a prime size.
Shards take turns in their given order and claim the first free slot of their own order until the table is full.
A key's slot is its hash modulo the size; one look at the broadcast table then names its shard. Shards differ by
one slot at most (with equal weights), and losing a shard moves few keys besides its own.

The table has a fixed number of rows (size, a parameter), so its broadcast does not grow with the data. Placement is
a narrow step: no shuffle, so a hot key or source costs nothing.

Defined cases: a null key is placed as the empty string; equal keys share a shard; an empty input gives no rows;
columns of the input named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 8191  # prime
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def hash60(text: Column) -> Column:
    """The first 60 bits of MD5 as a long: the same in other engines."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """(slot int, shard string), a row for each slot. A shard of weight w takes w turns in a row."""
    weights = list(weights or [1] * len(shards))
    if not _is_prime(size) or len(set(shards)) != len(shards) or len(weights) != len(shards) or min(weights, default=0) < 1 or sum(weights) > size or len(shards) > 65535:
        raise ValueError("need distinct shards, weights of 1 or more and a prime size that is at least the sum of weights")
    names = F.array(*(F.lit(s) for s in shards))
    queue = F.array(
        *(
            F.struct(
                F.lit(i).cast("long").alias("shard"),
                (hash60(F.lit(f"{s}#offset")) % size).alias("slot"),
                (hash60(F.lit(f"{s}#skip")) % (size - 1) + 1).alias("skip"),
                F.lit(w).alias("weight"),
            )
            for i, (s, w) in enumerate(zip(shards, weights))
        )
    )
    # The shard whose turn it is heads the queue. One step looks at one slot: claim it, or move on along the walk.
    # owners has two bytes for each slot, the shard's number plus 1: reading is constant-time, marking a short copy,
    # and binary values are not copied from step to step as arrays are.
    start = F.struct(queue.alias("queue"), F.unhex(F.repeat(F.lit("0000"), size)).alias("owners"), F.lit(1).alias("turn"), F.lit(0).alias("filled"))

    def step(acc: Column, _: Column) -> Column:
        head, rest = F.element_at(acc["queue"], 1), F.slice(acc["queue"], 2, len(shards))
        at = head["slot"].cast("int") * 2 + 1
        moved = F.array(F.struct(head["shard"].alias("shard"), ((head["slot"] + head["skip"]) % size).alias("slot"), head["skip"].alias("skip"), head["weight"].alias("weight")))
        goes_on = acc["turn"] < head["weight"]
        full = acc["filled"] == size - 1
        claim = F.struct(
            F.when(full, F.slice(acc["queue"], 1, 0)).when(goes_on, F.concat(moved, rest)).otherwise(F.concat(rest, moved)).alias("queue"),
            F.overlay(acc["owners"], F.unhex(F.lpad(F.hex(head["shard"] + 1), 4, "0")), at, F.lit(2)).alias("owners"),
            F.when(goes_on, acc["turn"] + 1).otherwise(1).alias("turn"),
            (acc["filled"] + 1).alias("filled"),
        )
        on = F.struct(F.concat(moved, rest).alias("queue"), acc["owners"].alias("owners"), acc["turn"].alias("turn"), acc["filled"].alias("filled"))
        is_free = F.substring(acc["owners"], at, F.lit(2)) == F.unhex(F.lit("0000"))
        return F.when(acc["filled"] >= size, acc).when(is_free, claim).otherwise(on)

    # A shard looks at each slot once at most, so this many steps always suffice.
    steps = F.sequence(F.lit(1), F.lit(size * len(shards)))
    owners = spark.range(1).select(F.aggregate(steps, start, step, lambda acc: acc["owners"]).alias("owners"))
    slots = owners.select("owners", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    owner = F.conv(F.hex(F.substring("owners", F.col("slot") * 2 + 1, F.lit(2))), 16, 10).cast("int")
    return slots.select("slot", F.element_at(names, owner).alias("shard"))


def shard(df: DataFrame, key: str, table: DataFrame, size: int = SIZE) -> DataFrame:
    """df with slot and shard, by the key column. table: of lookup_table with the same size."""
    slotted = df.drop("slot", "shard").withColumn("slot", (hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))) % size).cast("int"))
    return slotted.join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write a sharded frame as shard=.../ folders; files_per_shard salts large shards over several writers."""
    salt = (F.abs(F.xxhash64(*df.columns)) % files_per_shard).alias("salt")
    df.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
