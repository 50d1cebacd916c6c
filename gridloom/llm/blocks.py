"""Groups of any size, compared in blocks of bounded size.

Rows that share a bucket may be compared pair by pair. Buckets of the same least member make one group, so
that a member is sent once for each such leader rather than for each bucket. A group of more than
``block`` members is cut into chunks by a hash of the member; each pair of chunks is a task's unit of work,
and a member is sent to every pair its chunk takes part in. So no task holds more than two chunks, whatever
a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import dropped, written

#: A key is hot from so many rows on, or from a HOT_KEYS-th of all rows if that is more: so there are fewer than HOT_KEYS hot keys.
HOT, HOT_KEYS = 128, 100_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key and, as ``size``, how many of the ``total`` rows have it.

    Hot keys' rows stay where they are, as their part of the table is broadcast, and its size is bounded
    by HOT_KEYS; the others are shuffled. ``rows`` is read twice, so it should be a written table.
    """
    limit = max(HOT, total // HOT_KEYS)
    hot, rest = table.where(F.col("size") > limit), table.where(F.col("size") <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def led(classes: DataFrame, member: str, buckets: str, alone: int = 0) -> DataFrame:
    """(member, rep, n, gs): of members that share a bucket with others, for each such bucket its place t, group g and the group's size.

    ``classes`` has a row for each member, its smallest id ``rep``, how often it occurs as ``n``, and an
    array of buckets. A group is named after the least (rep, member) of the bucket; but a bucket of up to
    ``alone`` members is a group of its own, which suits buckets that many share by chance.
    """
    spread = written(classes.select(member, "rep", "n", F.posexplode(buckets).alias("t", "bucket")), "buckets")
    leaders = spread.groupBy("bucket").agg(F.min(F.struct("rep", member)).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    leaders = leaders.select("bucket", "size", F.when(F.col("size") > alone, F.xxhash64("lead")).otherwise(F.col("bucket")).alias("g"))
    placed = written(join_hot(spread, leaders, "bucket", spread.count()).select(member, "rep", "n", "t", "g"), "placed")
    dropped(spread)
    pairs = written(placed.select("g", member).distinct(), "pairs")
    sizes = written(pairs.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "sizes")
    sized = join_hot(pairs, sizes, "g", pairs.count()).select(member, F.struct("g", "size").alias("group"))
    groups = sized.groupBy(member).agg(F.collect_list("group").alias("groups"))
    return placed.groupBy(member, "rep", "n").agg(F.collect_list(F.struct("t", "g")).alias("gs")).join(groups, member)


def leads(gs: pa.Array, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member (of an array of lists of t and g) its group by table, and whether it has one there."""
    rows = np.repeat(np.arange(len(gs)), np.diff(gs.offsets.to_numpy()))
    flat = gs.flatten()
    t, g = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("t", "g"))
    lead, has = np.zeros((len(gs), tables), np.int64), np.zeros((len(gs), tables), bool)
    lead[rows, t], has[rows, t] = g, True
    return lead, has


def counted_here(lead: np.ndarray, has: np.ndarray, i: np.ndarray, j: np.ndarray, g: int) -> np.ndarray:
    """Whether each pair is counted in group ``g``: the smallest of those in which both meet by the same table."""
    out = np.zeros(len(i), bool)
    most = np.iinfo(np.int64).max
    for k in range(0, len(i), 1 << 15):
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        meet = (lead[a] == lead[b]) & has[a] & has[b]
        out[k : k + (1 << 15)] = meet.any(1) & (np.where(meet, lead[a], most).min(1, initial=most) == g)
    return out


def chunk_pairs(member: Column, size: Column, block: int) -> Column:
    """Array of (a, b) with a <= b: the chunk pairs that a member of a group of ``size`` takes part in, and its own chunk."""
    chunks = F.ceil(size / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), chunks.cast("bigint")).cast("int")
    return F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b"), own.alias("own")),
    )


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys side by side in one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Splits sorted batches into tables of equal keys, across batch borders."""
    held: list[pa.RecordBatch] = []

    def of(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        differ = np.zeros(n - 1, bool)
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            differ |= col[1:] != col[:-1]
        cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and of(held[0], 0) != of(part, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links (a[i], b[i]); labels sink, then jump."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
