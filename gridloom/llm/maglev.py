"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the production table: a prime, over 100 for each of up to 600 shards.
SLOTS = 65537
#: Rows of a shard that one task writes to one file.
FILE_ROWS = 250_000


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each of ``slots`` slots.

    Shards take turns; each turn claims the first free slot in the shard's own order, which starts at a
    hashed offset and goes on by a hashed step (a permutation, as ``slots`` is prime). Shares differ by
    one slot at most, and a shard that comes or goes moves few slots besides its own.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(slots) or len(shards) > slots:
        raise ValueError("slots must be a prime and at least the number of shards")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its md5 modulo ``slots``; a null key is slot 0."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint") % slots, F.lit(0))


def slot_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the lookup table as rows; its size is ``slots``, whatever the data."""
    names = [(s, shards[i]) for s, i in enumerate(lookup_table(shards, slots))]
    return spark.createDataFrame(names, "slot long, shard string")


def assign_shards(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row, by one lookup in a broadcast table of fixed size: no shuffle.

    Rows of a null key go to slot 0's shard, repeated keys to the same shard. Columns named ``slot`` or
    ``shard`` that are there already are replaced. Key on a fine-grained id: a hot key's rows stay together.
    """
    table = F.broadcast(slot_frame(df.sparkSession, shards, slots))
    rest = df.drop(*[c for c in df.columns if c.lower() in ("slot", "shard") and c != key])
    keyed = rest.withColumn("__slot", slot_of(F.col(key), slots))
    table = table.withColumnRenamed("slot", "__slot_id").withColumnRenamed("shard", "__shard")
    out = keyed.join(table, keyed["__slot"] == table["__slot_id"], "left").drop("__slot_id")
    return out.drop(*[c for c in ("slot", "shard") if c in out.columns and c == key]).withColumnsRenamed({"__slot": "slot", "__shard": "shard"})


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, rows: int = FILE_ROWS, slots: int = SLOTS) -> None:
    """Writes all rows, with their slot, to ``path``/shard=.../, each shard in files of about ``rows`` rows, a task a file.

    A first pass over the keys counts each shard's rows, so that a hot one is dealt to as many tasks as it
    needs, equal rows too. Shards without rows have no folder; an empty table writes no shards.
    """
    placed = assign_shards(df, key, shards, slots)
    files = assign_shards(df.select(key), key, shards, slots).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / rows).alias("__files")).withColumnRenamed("shard", "__shard")
    dealt = placed.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(files), F.col("shard") == F.col("__shard"))
    salted = dealt.withColumn("__salt", F.pmod(F.col("__row"), F.col("__files")))
    salted.repartition("shard", "__salt").drop("__row", "__files", "__shard", "__salt").write.partitionBy("shard").parquet(path)
