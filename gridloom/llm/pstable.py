"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

The tables are worked through a few at a time: a round sends each vector once for each of its tables, packed
with others of the same destination, and its shuffle is gone before the next one. So what lies on disk at
once is a few times the vectors, however many tables there are.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.blocks import join_hot, local_roots, runs
from gridloom.llm.components import connected_components
from gridloom.llm.store import dropped, freeing, new_path, tidy, written

#: A bucket of more members is cut into chunks; smaller buckets are compared side by side, up to WINDOW rows.
BLOCK, WINDOW = 32768, 128
PROJECTIONS, WIDTH, RECALL, SEED = 8, 2.0, 0.999, 20240229
#: Bytes that a round may shuffle, two tables at least; bytes of a task's buckets, of vectors packed at once; entries of a product.
ROUND, PART, FLUSH, TILE = 256 << 20, 8 << 20, 16 << 20, 1 << 20
#: Microseconds to send a vector for a table and to compare it with another, which choose the projections.
SENDING, COMPARING = 2.0, 0.003


def collision(distance: float, width: float) -> float:
    """Chance that a Gaussian projection puts two points at ``distance`` in one cell of ``width``."""
    if distance <= 0:
        return 1.0
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(threshold: float, recall: float = RECALL, k: int = PROJECTIONS, width: float = WIDTH) -> int:
    """Tables of ``k`` projections each that find a pair at the threshold with chance ``recall``; closer pairs more surely."""
    near = collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width) ** k
    return 1 if near >= recall else math.ceil(math.log(1 - recall) / math.log(1 - near))


def projections_for(n: int, threshold: float, recall: float = RECALL, width: float = WIDTH) -> int:
    """Projections a table that cost least for ``n`` vectors, PROJECTIONS at least: more of them part chance members but take more tables."""
    chance = collision(math.sqrt(2), width)
    return min(range(PROJECTIONS, 41), key=lambda k: tables_for(threshold, recall, k, width) * (SENDING + COMPARING * n * chance**k / 2))


def _unit(v: np.ndarray) -> np.ndarray:
    u = v.astype(np.float64)
    if v.dtype != np.float32:  # whose squares a double can't hold
        u /= np.abs(u).max(1, keepdims=True)
    u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
    return u


class _Hashes:
    """The functions of all tables, for vectors of any length."""

    def __init__(self, tables: int, k: int, width: float, seed: int) -> None:
        self.tables, self.k, self.width, self.seed = tables, k, width, seed
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cells(self, u: np.ndarray, first: int, last: int) -> np.ndarray:
        """A 64-bit bucket for each row and table in [first, last), from its quantised projections, the table and the dimension."""
        dim, k = u.shape[1], self.k
        if dim not in self.of:
            rng = np.random.default_rng([self.seed, dim])
            self.of[dim] = rng.standard_normal((dim, self.tables * k)), rng.uniform(0, self.width, self.tables * k)
        a, b = (x[..., first * k : last * k] for x in self.of[dim])
        q = np.floor((u @ a + b) / self.width).astype(np.int64).view(np.uint64).reshape(len(u), last - first, k)
        h = np.tile(np.arange(first, last, dtype=np.uint64) << np.uint64(32) | np.uint64(dim), (len(u), 1))
        for i in range(k):
            h = (h ^ q[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h


def _record(size: int) -> np.dtype:
    """A vector of ``size`` bytes in a unit ``g`` of table ``t``: of a whole bucket or one chunk (side 0), or of two chunks (1 and 2)."""
    return np.dtype([("g", "<u8"), ("rep", "<i8"), ("n", "<i8"), ("t", "<u2"), ("side", "u1"), ("raw", f"V{size}")])


def _sent(g: np.ndarray, rep: np.ndarray, hot: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, unit and side of all that is sent for buckets ``g``: once, or to each pair of chunks that takes part of a hot one."""
    rows, side = np.arange(len(g)), np.zeros(len(g), np.uint8)
    if not len(hot):
        return rows, g, side
    at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
    is_hot = hot[at] == g
    out = [(rows[~is_hot], g[~is_hot], side[~is_hot])]
    rows, of = rows[is_hot], chunks[at[is_hot]].astype(np.uint64)
    own = ((rep[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.maximum(of, np.uint64(1))
    for j in range(int(of.max(initial=0))):
        k = of > j
        x = own[k]
        a, b = np.minimum(x, np.uint64(j)), np.maximum(x, np.uint64(j))
        unit = ((g[rows[k]] ^ (a << np.uint64(32) | b)) * np.uint64(0xD6E8FEB86659FD93)) ^ (b + np.uint64(1))
        out.append((rows[k], unit, np.where(a == b, 0, np.where(x == a, 1, 2)).astype(np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _new(u: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray, hashes: _Hashes) -> np.ndarray:
    """Which pairs of rows, found in tables ``t``, share a bucket in no earlier one, where they are counted."""
    new, left = np.ones(len(i), bool), np.flatnonzero(t)
    place = np.zeros(len(u), np.int32)
    for first in range(0, int(t.max(initial=0)), 4):
        left = left[t[left] > first]
        if not len(left):
            break
        last = min(first + 4, hashes.tables)
        named = np.zeros(len(u), bool)
        named[i[left]] = named[j[left]] = True
        own = np.flatnonzero(named)
        place[own] = np.arange(len(own))
        cells = np.ascontiguousarray(hashes.cells(u[own], first, last).T)
        for x, cell in zip(range(first, last), cells):
            met = (cell[place[i[left]]] == cell[place[j[left]]]) & (t[left] > x)
            new[left[met]] = False
            left = left[~met]
    return new


def _places(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.flatnonzero(where)
    i = found // max(1, where.shape[1])
    return i, found - i * where.shape[1]


def _pairs(rec: np.ndarray, u: np.ndarray, low: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit whose cosine may be ``low`` or more, by products in single precision; rows are sorted by unit and side."""
    g, side, single = rec["g"].copy(), rec["side"].copy(), u.astype(np.float32)
    bounds = [*np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])).tolist(), len(g)]
    k = 0
    while k < len(bounds) - 1:
        start, end = bounds[k], bounds[k + 1]
        if end - start > WINDOW or side[start]:
            k += 1
            middle = start + int(np.searchsorted(side[start:end], 2)) if side[start] else end
            rows, step = (start, middle), max(16, TILE // (end - start))
            for x in range(*rows, step):
                y = min(x + step, middle)
                by = middle if side[start] else x
                i, j = _places(single[x:y] @ single[by:end].T >= low)
                i, j = i + x, j + by
                yield (i, j) if side[start] else (i[i < j], j[i < j])
        else:
            k = max(k + 1, bisect_right(bounds, start + WINDOW) - 1)
            while side[bounds[k] - 1]:  # units of two chunks stand alone
                k -= 1
            end = bounds[k]
            if end - start > 1:
                i, j = _places(single[start:end] @ single[start:end].T >= low)
                i, j = i + start, j + start
                same = (i < j) & (g[i] == g[j])
                yield i[same], j[same]


def _joined(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer arrays."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for x in pairs:
        if len(x[0]):
            held.append(x)
            n += len(x[0])
        if n >= 1 << 17:
            yield tuple(np.concatenate(y) for y in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(y) for y in zip(*held))


def near_vectors(df: DataFrame, key: str, vector: str, threshold: float = 0.9, recall: float = RECALL, k: int | None = None, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """One row a vector: key, n_links, component_id, kept.

    Links join vectors whose cosine in double precision is ``threshold`` or more; they are looked for
    among vectors that share a bucket in any of ``tables_for(threshold, recall, k)`` tables, and each is
    checked exactly; ``k`` projections make a bucket, as many as suit the number of vectors if it isn't
    given. n_links counts the other rows linked directly, component_id is the smallest key
    reachable, kept marks it. A vector that is null, empty, zero, or has a null or non-finite component
    links with nothing, nor do vectors of different lengths. Rows without a key have 0 links and a null
    component. Equal vectors are compared once and counted as often as they occur; a key that occurs with
    several vectors is one node. An empty table gives no rows.
    """
    with tidy(df.sparkSession):
        return _near_vectors(df, key, vector, threshold, recall, k, width, seed)


def _near_vectors(df: DataFrame, key: str, vector: str, threshold: float, recall: float, k: int | None, width: float, seed: int) -> DataFrame:
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    own = pa.float32() if kind == "<f4" else pa.float64()

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            for x in batch.column(1):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.cast(own).to_numpy(zero_copy_only=False)
                    v = v if np.isfinite(v).all() and v.any() else None
                raw.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "raw"])

    column = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("bigint").alias("id"), column.alias("v")).mapInArrow(freeing(serialized), "id long, raw binary")
    rows = written(rows.withColumn("class", F.substring(F.unhex(F.sha2("raw", 256)), 1, 16)), "vectors")
    classes = rows.where("raw is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw"))
    classes = written(classes, "classes")
    ids = written(rows.select("id", "class"), "ids")
    dropped(rows)
    known = ids.where("class is not null and id is not null")
    found = _links(classes, kind, threshold, recall, k, width, seed)
    slim = written(classes.select("class", "rep", "n"), "slim")
    dropped(classes)

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.select("rep", "root")
    if _repeats(known):
        edges = edges.union(known.join(slim.select("class", "rep"), "class").where("id <> rep").select("id", "rep"))
    parts = connected_components(edges, "rep", "root")
    by_class = slim.join(links, "class", "left")
    by_class = by_class.join(parts, by_class["rep"] == parts["node"], "left").select(
        "class", F.col("n").alias("size"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    by_class = written(by_class, "by_class")
    linked_rows = join_hot(known, by_class, "class", ids.count()).select("id", "n_links", "component_id")
    alone = ids.where("class is null or id is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked_rows.unionByName(alone)
    return out.select(
        F.col("id").alias(key),
        F.col("n_links").cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _links(classes: DataFrame, kind: str, threshold: float, recall: float, k: int | None, width: float, seed: int) -> DataFrame:
    """(rep, class, links, root): of classes with links, how many rows of others a table has found, and an edge of the component."""
    spark = classes.sparkSession
    n, size = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()
    k = k or projections_for(n, threshold, recall, width)
    hashes = _Hashes(tables_for(threshold, recall, k, width), k, width, seed)
    each = size + n * _record(0).itemsize
    step = max(2, ROUND // max(1, each))
    n_parts = max(2 * spark.sparkContext.defaultParallelism, math.ceil(each * min(step, hashes.tables) / PART))

    def of_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of vectors in bytes the rows that have it, and their bytes."""
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data, sizes = np.frombuffer(column.buffers()[2], np.uint8), np.diff(ends)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            yield int(size), rows, data[ends[0] : ends[-1]].reshape(-1, size) if len(rows) == len(sizes) else data[ends[rows][:, None] + np.arange(size)]

    # A bucket is hot by a sample that has 128 of a block's rows; sizes are needed no more exactly than that.
    every = max(1, BLOCK // 128)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw in of_size(batch.column(0)):
                u = _unit(raw.view(kind))
                for t in range(0, hashes.tables, 16):
                    g, count = np.unique(hashes.cells(u, t, min(t + 16, hashes.tables)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(count)], ["g", "n"])

    hot, chunks = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > BLOCK:
        some = classes.where(F.pmod(F.xxhash64("class"), F.lit(every)) == 0).select("raw")
        counts = some.mapInArrow(freeing(sampled), "g long, n long").groupBy("g").agg((F.sum("n") * every).alias("n")).where(F.col("n") > BLOCK)
        large = sorted((r.g % (1 << 64), math.ceil(r.n / BLOCK)) for r in counts.collect())
        hot, chunks = np.array([g for g, _ in large], np.uint64), np.array([c for _, c in large], np.int64)

    def packed(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(x.nbytes for x in held) > FLUSH:
                    yield from flushed(held)
                    held = []
            if held:
                yield from flushed(held)

        def flushed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            if not table.num_rows:
                return
            reps, ns = (table.column(c).to_numpy() for c in ("rep", "n"))
            for size, rows, raw in of_size(table.column("raw").chunk(0)):
                u, kind_of, rep = _unit(raw.view(kind)), _record(size), reps[rows]
                for t in range(first, last):
                    at, g, side = _sent(hashes.cells(u, t, t + 1)[:, 0], rep, hot, chunks)
                    part = (g % np.uint64(n_parts)).astype(np.int32)
                    order = np.argsort(part, kind="stable")
                    at, part = at[order], part[order]
                    rec = np.empty(len(at), kind_of)
                    rec["g"], rec["rep"], rec["n"], rec["t"], rec["side"] = g[order], rep[at], ns[rows][at], t, side[order]
                    rec["raw"] = raw[at].view(f"V{size}")[:, 0]
                    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    for x in range(0, len(starts), 4096):
                        some = starts[x : x + 4097]
                        ends = np.append(some, len(rec)) if x + 4096 >= len(starts) else some
                        blob = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(((ends - ends[0]) * kind_of.itemsize).astype(np.int32)), pa.py_buffer(rec[ends[0] : ends[-1]].tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(part[ends[:-1]]), pa.array(np.full(len(ends) - 1, size, np.int32)), blob], ["p", "size", "blob"])

        return run

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["p", "size"]):
            rec = np.concatenate([np.frombuffer(x.as_buffer(), _record(group.column("size")[0].as_py())) for x in group.column("blob")])
            rec = rec[np.lexsort([rec["side"], rec["g"]]) if rec["side"].any() else np.argsort(rec["g"].copy())]
            u = _unit(np.ascontiguousarray(rec["raw"]).view(kind).reshape(len(rec), -1))
            links, n = np.zeros(len(rec), np.int64), rec["n"]
            edges = [np.zeros((2, 0), np.int64)]
            for i, j in _joined(_pairs(rec, u, threshold - (u.shape[1] + 8) * 2.0**-22)):
                new = _new(u, i, j, rec["t"][i].astype(np.int64), hashes)
                i, j = i[new], j[new]
                exact = np.zeros(len(i), bool)
                for x in range(0, len(i), 1 << 14):
                    y = x + (1 << 14)
                    exact[x:y] = np.einsum("ij,ij->i", u[i[x:y]], u[j[x:y]]) >= threshold
                i, j = i[exact], j[exact]
                if len(i):
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                    edges.append(np.stack([own, own[local_roots(len(own), at[: len(i)], at[len(i) :])]]))
            at = np.flatnonzero(links)
            if len(at):
                root = local_roots(len(rec), *np.concatenate(edges, 1))
                classes_of = [hashlib.sha256(rec["raw"][x].tobytes()).digest()[:16] for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(rec["rep"][at]), pa.array(classes_of, pa.binary()), pa.array(links[at]), pa.array(rec["rep"][root[at]])], ["rep", "class", "links", "root"])

    path, schema = new_path(spark, "links"), "rep long, class binary, links long, root long"
    for first in range(0, hashes.tables, step):
        sent = classes.select("rep", "n", "raw").mapInArrow(freeing(packed(first, min(first + step, hashes.tables))), "p int, size int, blob binary")
        sent.repartition(n_parts, "p").sortWithinPartitions("p", "size").mapInArrow(freeing(linked), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _repeats(known: DataFrame) -> bool:
    """Whether a key occurs with several vectors, which then are one node."""
    return bool(known.groupBy("id").agg(F.count_distinct("class").alias("n")).where("n > 1").limit(1).count())
