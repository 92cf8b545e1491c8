"""Placing rows on shards through a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime
size, given by an offset and a step drawn from its name.  The shards take
turns, each claiming its next free slot, until the table is full, so that each
owns nearly the same number of slots, and few slots change hands when a shard
joins or leaves.  A row's slot is its key's hash modulo the table size; the
table (a fixed number of rows) is broadcast.

Cases: a null key is placed like an empty one; repeated keys share a shard.
Empty tables give empty results.  The columns ``slot`` and ``shard`` replace
columns of those names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import hash_key

TABLE_SIZE = 16381  # prime


def _number(name: str, seed: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The owning shard (its place in ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("needs distinct shard names, no more than slots")
    if any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be prime")
    at = [_number(name, "offset") % size for name in shards]
    step = [_number(name, "step") % (size - 1) + 1 for name in shards]
    owner = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % size
        owner[at[shard]] = shard
    return owner


def with_shard(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard`` (a name of ``shards``)."""
    owner = lookup_table(shards, size)
    table = df.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(owner)], "slot bigint, shard string")
    slot = (hash_key(df[key]) % size).alias("slot")
    kept = [df[c] for c in df.columns if c.lower() not in ("slot", "shard")]
    return df.select(*kept, slot).join(F.broadcast(table), "slot").select(*[c for c in df.columns if c.lower() not in ("slot", "shard")], "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files: int = 1, size: int = TABLE_SIZE) -> None:
    """Write one folder per shard, each in up to ``files`` files, spread by slot."""
    placed = with_shard(df, key, shards, size).withColumn("part_", F.pmod(F.col("slot"), F.lit(files)))
    placed.repartition(len(shards) * files, "shard", "part_").drop("part_").write.partitionBy("shard").parquet(path)
