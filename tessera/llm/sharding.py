"""Sharding by a permutation-filled lookup table (the table of Maglev, Eisenbud et al. 2016).

Every shard has its own preference order over the slots of a prime-sized table; the shards take turns
claiming the first slot of their order that is still free. The filled table depends on the shard names and
the table size alone, so it is planned once on the driver, and its size is a parameter, never the data's:
broadcasting it is safe at any scale. A row's shard is one hash, one modulo and one probe of that table.
Losing a shard moves that shard's keys and few others.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime and over a hundred times the number of shards, so shares differ by about a percent at most.
TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 655_373
SHARDS = tuple(f"shard-{i:04d}" for i in range(64))


def fill_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> list[int]:
    """The index of the owning shard for every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not len(shards) <= size <= MAX_TABLE_SIZE or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime between the number of shards and MAX_TABLE_SIZE")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:], "big") % (size - 1) + 1 if size > 1 else 1 for d in digests]
    owner, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key, size: int = TABLE_SIZE):
    """Slot of a key column: 60 bits of the md5 of its text, modulo the table size; a null key is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as rows (slot, shard, shard_name), made from one packed literal without any Python worker."""
    packed = F.lit(struct.pack(f">{size}H" if len(shards) < 65_536 else f">{size}I", *fill_table(shards, size)))
    width = 2 if len(shards) < 65_536 else 4
    entry = F.substring(packed, (F.col("id") * width + 1).cast("int"), F.lit(width))
    names = F.array(*map(F.lit, shards))
    shard = F.conv(F.hex(entry), 16, 10).cast("int")
    return spark.range(size).select(F.col("id").cast("int").alias("slot"), shard.alias("shard")).withColumn("shard_name", F.get(names, F.col("shard")))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with slot, shard and shard_name. No shuffle: a hash, and a probe of the broadcast table.

    Null keys all take the slot of the empty text; repeated keys get the same shard; an empty table gives no
    rows; input columns named slot, shard or shard_name are replaced.
    """
    own = [c for c in df.columns if c.lower() not in ("slot", "shard", "shard_name")]
    placed = df.select(*[F.col(f"`{c}`") for c in own], slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return placed.join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "slot").select(*[F.col(f"`{c}`") for c in own], "slot", "shard", "shard_name")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, parts: int = 1) -> None:
    """Writes ``df`` in one folder a shard, each in ``parts`` parts, so no task gets more than that part of a shard."""
    placed = assign_shards(df, key, shards, size).withColumn("__part", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(parts)))
    placed.repartition(len(shards) * parts, "shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)
