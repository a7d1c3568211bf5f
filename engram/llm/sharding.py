"""Placing rows on shards with a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: offset, offset + skip, ... modulo the size.
The shards take turns, each claiming its next preferred free slot, until no slot is free. A key goes to the shard of
slot hash(key) modulo size. Adding or removing a shard moves few keys beyond those that must move.

The table is filled on the driver from the shard names alone (its size is a parameter, not data) and reaches the
executors as a broadcast of exactly table_size rows; placement is one hash and one lookup per row, with no shuffle.

Nulls and edges: a null id hashes like the empty text; repeated ids go to the same shard; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(100))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, table_size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards:
        raise ValueError("at least one shard is needed")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names must differ")
    if not _is_prime(table_size) or table_size < len(shards):
        raise ValueError("table_size must be a prime of at least the number of shards")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % table_size for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (table_size - 1) + 1 for d in digests]
    owner, free = [-1] * table_size, table_size
    while True:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % table_size
            owner[at[shard]] = shard
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """48 bits of md5 of the key as text, modulo the table size."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10)
    return (bits.cast("long") % table_size).cast("int")


def placed_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """m_slot, m_shard: one row per slot."""
    text = ",".join(map(str, lookup_table(shards, table_size)))
    return spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(text), ",")).alias("m_slot", "m_shard")).select(
        "m_slot", F.col("m_shard").cast("int").alias("m_shard"))


def shard(docs: DataFrame, shards: tuple[str, ...] = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """docs: doc_id. Returns doc_id, slot, shard for every row."""
    rows = docs.select("doc_id", slot_of(F.col("doc_id"), table_size).alias("slot"))
    table = placed_table(docs.sparkSession, shards, table_size)
    return rows.join(F.broadcast(table), F.col("slot") == F.col("m_slot")).select("doc_id", "slot", F.col("m_shard").alias("shard"))


def oracle_sql(shards: tuple[str, ...] = SHARDS, table_size: int = TABLE_SIZE) -> str:
    return f"""
WITH t AS (SELECT [{",".join(map(str, lookup_table(shards, table_size)))}] AS owner),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {table_size})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, owner[slot + 1]::INTEGER AS shard FROM d, t
"""
