"""Consistent placement by a permutation-filled lookup table.

Every shard has its own permutation of a prime number of slots: a hash gives where it
begins and another how far it steps.  Shards take turns, each claiming the next
free slot of its permutation, until the table is full, so each holds
its share of slots to within one (or to its weight) and a change of shards moves few slots.  The table has
TABLE slots whatever the data; it is broadcast, and a row's shard is one lookup.

A key with more than 1 / (2 shards) of all rows would fill a shard alone.  There are fewer
than 2 shards of those; their rows are dealt over all slots by key and row instead.

Edge cases: a null key is a key like others; repeated rows go to one shard unless their key
is hot and their salt differs; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TABLE = 65_537


def _hash(name: str, use: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{use}:{name}".encode(), digest_size=8).digest(), "big")


def fill(shards: list[str], size: int = TABLE, weights: dict[str, int] | None = None) -> list[int]:
    """The shard (its place in shards) of each slot.  size must be prime and at least the number of shards."""
    if len(shards) != len(set(shards)) or not shards or size < len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("shards must be distinct and the size a prime that holds them")
    if any(w < 1 for w in (weights or {}).values()):
        raise ValueError("weights are 1 at least")
    at = [_hash(s, "offset") % size for s in shards]
    step = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    turns = [(weights or {}).get(s, 1) for s in shards]
    table, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            for _ in range(turns[i]):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                table[at[i]] = i
                free -= 1
                if not free:
                    return table
    return table


def slot(*columns: Column, size: int = TABLE) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(size).cast("long")).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], salt: list[str] = (), size: int = TABLE, weights: dict[str, int] | None = None) -> DataFrame:
    """rows with slot, shard and hot.  salt: the columns that part the rows of a hot key."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(shards[i] for i in fill(shards, size, weights))), "slot int, shard string")
    by_key = rows.select(F.xxhash64(key).alias("_key"))
    total = by_key.count()
    # more than total / (2 shards) rows: fewer than 2 shards keys
    hot = [r[0] for r in by_key.groupBy("_key").count().where(F.col("count") > max(1.0, total / (2 * len(shards)))).select("_key").collect()]
    taken = [c for c in ("slot", "shard", "hot") if c in {x.lower() for x in rows.columns}]
    kept = [F.col(c) for c in rows.columns if c.lower() not in taken]
    is_hot = F.xxhash64(key).isin(hot) if hot else F.lit(False)
    own = F.when(is_hot, slot(F.col(key), *[F.col(c) for c in salt], size=size)).otherwise(slot(F.col(key), size=size))
    return rows.select(*kept, own.alias("slot"), is_hot.alias("hot")).join(F.broadcast(table), "slot", "left").select(*kept, "slot", "shard", "hot")


def write(placed: DataFrame, path: str) -> None:
    """A folder for each shard, whose rows come from as many tasks as it needs."""
    placed.repartition(common.partitions(placed.sparkSession), "shard", F.pmod(F.col("slot"), F.lit(16))).write.partitionBy("shard").parquet(path)
