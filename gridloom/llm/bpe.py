"""Byte-level BPE by a segment tree of pair ranks.

Each leaf of the tree is a byte position of a piece and holds the rank of the pair that starts there, or
NONE; inner nodes hold the minimum, with the position as the lower bits, so that the root is the leftmost
pair of lowest rank. A merge rewrites three leaves (the pair, its dead right half and the live left
neighbour) and their paths to the root. Short pieces share one tree per size class, held as arrays with
a row a piece and stepped together; pieces over WIDE bytes have a tree of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import freeing

NONE = np.iinfo(np.int64).max
WIDE = 64
#: Bytes of pieces that a task remembers, with their ids; the cache starts anew when it is full. Pieces over WIDE bytes aren't kept.
CACHE = 4 << 20
#: Pieces of one step, so that a text of any length is held in parts.
STEP = 32_768
#: Leaves of all trees that are stepped together.
CELLS = 1 << 17

_models: dict[tuple[str, str], "SegmentTreeBpe"] = {}


class SegmentTreeBpe:
    """Encoder and decoder for a rank file and the pattern that splits text before merging."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.pieces = regex.compile(pattern)
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        known = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    known.append((a << 32 | b, rank))
        table = np.array(known, np.int64)
        table = table[np.argsort(table[:, 0])]
        self.keys, self.values = np.append(table[:, 0], NONE), np.append(table[:, 1], 0)
        self.single = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.forget()

    def forget(self) -> None:
        """Empties the cache of pieces."""
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _rank(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
        """Leaves for the pairs (a, b) that start at ``at``; a token below 0 is the end."""
        key = a << 32 | b
        i = np.searchsorted(self.keys, key)
        known = (self.keys[i] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.values[i] << bits | at, NONE)

    def _together(self, pieces: list[bytes], bits: int) -> list[bytes]:
        """Ids of pieces of at most 2**bits bytes, as little-endian 32-bit integers."""
        n, rows = 1 << bits, len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), np.uint8).reshape(rows, n)
        cols = np.arange(n)
        live = cols < size[:, None]
        token = np.full((rows, n + 1), -1, np.int64)
        token[:, :n] = np.where(live, self.first[raw], -1)
        after = np.minimum(np.broadcast_to(np.arange(1, n + 2), (rows, n + 1)), n).copy()
        after[:, :n] = np.where(after[:, :n] < size[:, None], after[:, :n], n)
        before = np.broadcast_to(np.arange(-1, n), (rows, n + 1)).copy()
        before[:, 0] = n
        tree = np.full((rows, 2 * n), NONE, np.int64)
        tree[:, n:] = self._rank(token[:, :n], np.take_along_axis(token, after[:, :n], 1), cols, bits)
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            best = tree[row, 1]
            at = best & (n - 1)
            dead = after[row, at]
            right = after[row, dead]
            left = before[row, at]
            token[row, at], token[row, dead] = best >> bits, -1
            after[row, at], before[row, right] = right, at
            before[row, 0] = n
            tree[row, n + dead] = NONE
            tree[row, n + at] = self._rank(token[row, at], token[row, right], at, bits)
            has = left < n
            r, p = row[has], left[has]
            tree[r, n + p] = self._rank(token[r, p], token[r, at[has]], p, bits)
            node_r = np.concatenate([row, row, r])
            node = np.concatenate([at, dead, p]) + n
            for _ in range(bits):
                node = node >> 1
                tree[node_r, node] = np.minimum(tree[node_r, 2 * node], tree[node_r, 2 * node + 1])
            row = row[tree[row, 1] != NONE]
        kept = token[:, :n] >= 0
        flat = token[:, :n][kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _alone(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, as ``_together`` gives them."""
        n = 1 << (len(piece) - 1).bit_length()
        token = [int(self.first[b]) for b in piece]
        after = [*range(1, len(piece)), -1]
        before = [*range(-1, len(piece) - 1)]
        ranks, tokens = self.ranks, self.tokens
        end = (NONE, 0)
        tree = [end] * (2 * n)

        def leaf(i: int) -> tuple[int, int]:
            j = after[i]
            rank = ranks.get(tokens[token[i]] + tokens[token[j]]) if j >= 0 else None
            return end if rank is None else (rank, i)

        def lift(i: int) -> None:
            i = (i + n) >> 1
            while i:
                tree[i] = min(tree[2 * i], tree[2 * i + 1])
                i >>= 1

        for i in range(len(piece)):
            tree[n + i] = leaf(i)
        for i in range(n - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] is not end and tree[1][0] != NONE:
            rank, at = tree[1]
            dead = after[at]
            token[at], token[dead], after[at] = rank, -1, after[dead]
            if after[at] >= 0:
                before[after[at]] = at
            tree[n + dead] = end
            tree[n + at] = leaf(at)
            lift(dead)
            lift(at)
            if before[at] >= 0:
                tree[n + before[at]] = leaf(before[at])
                lift(before[at])
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers.

        A piece that is a token itself is that token, as the rank files' library has it.
        """
        out: list[bytes] = [b""] * len(pieces)
        sized: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = self.single[whole]
            elif len(p) > WIDE:
                out[i] = self._alone(p)
            elif p:
                sized.setdefault((len(p) - 1).bit_length(), []).append(i)
        for bits, at in sized.items():
            for k in range(0, len(at), CELLS >> bits):
                some = at[k : k + (CELLS >> bits)]
                for i, ids in zip(some, self._together([pieces[i] for i in some], bits)):
                    out[i] = ids
        return out

    def _ids(self, groups: list[list[str]]) -> list[bytes]:
        """Each group's ids. Pieces are looked up in the cache, new ones encoded together."""
        every = set().union(*groups)
        known = {p: ids for p in every if (ids := self.cache.get(p)) is not None}
        new = [p for p in every if p not in known]
        if new:
            raw = [p.encode() for p in new]
            fresh = dict(zip(new, self.encode_pieces(raw)))
            known |= fresh
            short = {p: fresh[p] for p, r in zip(new, raw) if len(r) <= WIDE}
            if self.held > CACHE:
                self.forget()
            self.cache |= short
            self.held += sum(map(len, short)) + sum(map(len, short.values()))
        get = known.__getitem__
        return [b"".join(map(get, g)) for g in groups]

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each whole text, null as empty, in order."""
        held: list[list[str]] = []
        count = 0
        for t in texts:
            t = t or ""
            if len(t) > 8 * STEP:
                yield from (np.frombuffer(x, "<u4") for x in self._ids(held))
                held, count = [], 0
                found = self.pieces.finditer(t)
                parts = []
                while part := [m.group() for m in islice(found, STEP)]:
                    parts += self._ids([part])
                yield np.frombuffer(b"".join(parts), "<u4")
                continue
            held.append(self.pieces.findall(t))
            count += len(held[-1])
            if count > 2 * STEP:
                yield from (np.frombuffer(x, "<u4") for x in self._ids(held))
                held, count = [], 0
        if held:
            yield from (np.frombuffer(x, "<u4") for x in self._ids(held))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id outside the vocabulary raises."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def model(path: str, pattern: str) -> SegmentTreeBpe:
    """The model of a rank file; a process keeps the last one, as workers serve other stages too."""
    if (path, pattern) not in _models:
        _models.clear()
        _models[path, pattern] = SegmentTreeBpe(path, pattern)
    return _models[path, pattern]


def _lent(path: str, pattern: str, run: Callable[[SegmentTreeBpe, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with the model, whose cache ends with the task."""

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        try:
            yield from run(bpe, batches)
        finally:
            bpe.forget()

    return freeing(lent)


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """(key, ids array<int>): every whole text encoded; null texts have no ids, null and repeated keys stay rows of their own."""
    kind = df.select(key).schema[0].dataType

    def run(bpe: SegmentTreeBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = list(bpe.encode_batch(part.column(1).to_pylist()))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.array([], np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, flat)], ["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_lent(path, pattern, run), f"key {kind.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """(key, bytes): what the ids stand for; null ids give null, no ids empty bytes."""
    kind = df.select(key).schema[0].dataType

    def run(bpe: SegmentTreeBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                out = [bpe.decode(np.asarray(x.values, np.int64)) if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["key", "bytes"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(_lent(path, pattern, run), f"key {kind.simpleString()}, bytes binary").withColumnRenamed("key", key)


def round_trip_digests(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes every whole text and decodes the ids in one pass.

    The first digest is of the decimal ids joined by spaces, the second of the decoded bytes. A null text
    is empty: no ids, and the digests of nothing.
    """
    import hashlib

    kind = df.select(key).schema[0].dataType

    def run(bpe: SegmentTreeBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(map(str, range(len(bpe.tokens))))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, a, b = [], [], []
                for ids in bpe.encode_batch(part.column(1).to_pylist()):
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"key {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_lent(path, pattern, run), schema).withColumnRenamed("key", key)
