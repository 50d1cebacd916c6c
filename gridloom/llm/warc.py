"""WARC archives, written with revisit records and read by boundary-chain verification.

A reader task scans its own byte range for record starts and emits each candidate with its successor's
offset. A magic string inside a payload yields a candidate too; but only what is reached from offset 0
by following successors is a record. Candidates are contracted by pointer jumping inside each range,
then across ranges, so a file of k ranges takes log2(k) rounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import filesystem, freeing, new_path, written

#: Payloads below this many bytes are stored again rather than referred to.
LEAST_REVISIT = 1000
RANGE = 16 << 20
READ = 1 << 20
VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
#: The most a header may take.
HEADER = 16 << 20
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_id string"


def revisit_targets(pages: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(digest, bytes, keep): of each group of equal payloads of ``least`` bytes or more, the largest key.

    Only groups of several rows are listed. Pre-aggregated before the shuffle, so a hot payload costs one
    row a task. A group without any known key has a null ``keep``.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.sha1(body).alias("digest"), F.octet_length(body).cast("bigint").alias("bytes"), F.col(key).alias("k"))
    groups = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("k").alias("keep"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").drop("n")


def _urn(key: int | None) -> str:
    return f"<urn:gridloom:page:{'' if key is None else key}>"


def _record(key, url, kind, refers, size, digest, payload: bytes) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + payload if kind == "response" else head
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(key)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}")
    lines += ["WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, key: str, url: str, payload: str, folder: str | None = None, compress: bool = True, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for every row; returns the manifest (path, bytes, n_records).

    Null payloads are empty; null urls have no target line; null keys an empty record id. Of rows with
    equal payloads of ``least`` bytes or more, those of the largest key are responses and the others
    revisits; where no key of the group is known, all are responses. The payload is shuffled only where
    the table of repeated payloads is too large to broadcast. Each task writes one file under a name of
    its own and moves it when it is whole.
    """
    spark = pages.sparkSession
    root = folder or new_path(spark, "warc")
    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    targets = written(revisit_targets(pages, key, payload, least), "targets")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).cast("string").alias("u"), body.alias("body")).withColumn("digest", F.sha1("body")).withColumn("bytes", F.octet_length("body").cast("bigint"))
    joined = rows.join(targets, ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("keep").isNotNull() & ~F.col("k").eqNullSafe(F.col("keep")), F.lit(False))
    todo = joined.select("k", "u", "bytes", "digest", F.when(revisit, F.col("keep")).alias("refers"), F.when(~revisit, F.col("body")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, base = filesystem(root)
        end = "warc.gz" if compress else "warc"
        out, own, total, n = None, f"{base}/.{part:06d}-{uuid.uuid4().hex}", 0, 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(own)
                k, u, size, digest, refers, body = r
                raw = _record(k, u, "response" if body is not None else "revisit", refers, size, digest, body or b"")
                if compress:
                    z = zlib.compressobj(5, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                out.write(raw)
                total += len(raw)
                n += 1
        if out is None:
            return
        out.close()
        fs.move(own, f"{base}/part-{part:06d}.{end}")
        yield pa.RecordBatch.from_pydict({"path": [f"{root}/part-{part:06d}.{end}"], "bytes": pa.array([total], pa.int64()), "n_records": pa.array([n], pa.int64())})

    return written(todo.mapInArrow(freeing(run), "path string, bytes long, n_records long"), "manifest")


class _Reader:
    """Random access to a file by growing windows."""

    def __init__(self, path: str) -> None:
        fs, p = filesystem(path)
        self.file = fs.open_input_file(p)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, READ), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]

    def plain(self, at: int, whole: bool) -> tuple[bytes, int] | None:
        """A record's bytes (its header only, unless ``whole``) and the next record's offset, if one can start at ``at``."""
        n = 4096
        while True:
            head = self.read(at, n)
            if not head.startswith(VERSION[:5]):
                return None
            stop = head.find(b"\r\n\r\n")
            if stop >= 0:
                break
            if at + n >= self.size or n > HEADER:
                return None
            n *= 4
        m = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", head[:stop])
        if not m:
            return None
        after = at + stop + 4 + int(m[1]) + 4
        if after > self.size or self.read(after - 4, 4) != b"\r\n\r\n":
            return None
        return (self.read(at, after - at) if whole else b""), after

    def packed(self, at: int, whole: bool) -> tuple[bytes, int] | None:
        """The same for a record in a gzip member of its own."""
        z, got, pos, first = zlib.decompressobj(31), [], at, b""
        try:
            while not z.eof:
                raw = self.read(pos, 65536)
                if not raw:
                    return None
                pos += len(raw)
                out = z.decompress(raw)
                if len(first) < 5:
                    first += out[:5]
                    if not VERSION.startswith(first[:5]):
                        return None
                if whole:
                    got.append(out)
        except zlib.error:
            return None
        return (b"".join(got), pos - len(z.unused_data)) if first[:5] == VERSION[:5] else None


def _candidates(reader: _Reader, a: int, b: int, packed: bool) -> Iterator[tuple[int, int]]:
    magic = GZIP if packed else VERSION[:5]
    at, b = a, min(b, reader.size)  # a manifest may tell of more than there is
    while at < b:
        # A magic string that begins in the span may end behind it.
        span = reader.file.read_at(min(READ, b - at) + len(magic) - 1, at)
        i = span.find(magic)
        while i >= 0:
            if at + i < b and (found := (reader.packed if packed else reader.plain)(at + i, False)):
                yield at + i, found[1]
            i = span.find(magic, i + 1)
        at += min(READ, b - at)


def _ranges(manifest: DataFrame, size: int) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("bigint")))
    cut = manifest.select("path", "bytes", starts.alias("a")).withColumn("b", F.least(F.col("a") + size, F.col("bytes")))
    return cut.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def boundary_candidates(manifest: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, a, at, leave): every candidate in the range that begins at ``a``, and the offset at which its chain leaves the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader = _Reader(r["path"])
                found = list(_candidates(reader, r["a"], r["b"], r["path"].endswith(".gz"))) if r["a"] < reader.size else []
                if not found:
                    continue
                at, succ = np.array(found, np.int64).T
                place = np.searchsorted(at, succ)
                inside = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == succ)
                # A chain that ends inside the range at no candidate leaves at an offset that nothing starts at.
                jump = np.where(inside, place, np.arange(len(at)))
                while not np.array_equal(jump, further := jump[jump]):
                    jump = further
                yield pa.RecordBatch.from_pydict({"path": [r["path"]] * len(at), "a": pa.array([r["a"]] * len(at), pa.int64()), "at": at, "leave": succ[jump]})

    return _ranges(manifest, size).mapInArrow(freeing(run), "path string, a long, at long, leave long")


def _followed(manifest: DataFrame, size: int) -> DataFrame:
    """(path, a, at, leave): the candidates at which the chain from each file's start enters a range, and where it leaves that."""
    found = written(boundary_candidates(manifest, size), "candidates")
    reached = found.where("at = 0").select("path", "at")
    widest = manifest.agg(F.max("bytes")).first()[0] or 0
    jump = found.select("path", "at", F.col("leave").alias("to"))
    for _ in range(max(0, -(-widest // size) - 1).bit_length()):
        reached = written(reached.union(reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))).distinct(), "reached")
        jump = written(jump.alias("x").join(jump.alias("y"), (F.col("x.path") == F.col("y.path")) & (F.col("x.to") == F.col("y.at"))).select("x.path", "x.at", "y.to"), "jump")
    return found.join(reached, ["path", "at"]).select("path", "a", "at", "leave")


def chain_entries(manifest: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, a, at): where the chain from each file's start enters each range; ranges it skips have no row."""
    return _followed(manifest, size).select("path", "a", "at")


def _broken(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    ends = entries.groupBy("path").agg(F.max("leave").alias("offset"))
    stops = manifest.select("path", "bytes").join(ends, "path", "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    return stops.where("offset <> bytes").select("path", "offset", "bytes")


def broken_chains(manifest: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, offset, bytes): files whose chain of records ends before the file does, and where: a truncated or damaged record."""
    return _broken(_followed(manifest, size), manifest)


def _sha1(stated: str) -> str | None:
    """The hexadecimal SHA-1 of a digest field in base 32 or 16; None for other algorithms."""
    name, _, value = stated.partition(":")
    if name.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def _parsed(raw: bytes) -> tuple:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    block = block[: int(fields[b"content-length"])]

    def key(name: bytes) -> int | None:
        m = re.search(r"gridloom:page:(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    kind = fields.get(b"warc-type")
    ids = fields.get(b"warc-record-id"), fields.get(b"warc-refers-to")
    url, digest = fields.get(b"warc-target-uri"), _sha1(fields.get(b"warc-payload-digest", ""))
    if kind == "revisit":
        length = fields.get(b"x-payload-length", "")
        return key(b"warc-record-id"), url, kind, key(b"warc-refers-to"), int(length) if length.isdigit() else None, digest, None, *ids
    # Of an HTTP message the payload is its body; of other records the block.
    http = kind == "response" and fields.get(b"content-type", "").replace(" ", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    own = hashlib.sha1(payload).hexdigest()
    if digest not in (None, own):
        raise ValueError(f"the payload of {ids[0]} doesn't match its digest")
    return key(b"warc-record-id"), url, kind, None, len(payload), own, payload, *ids


def read_warc(manifest: DataFrame, payloads: bool = True, size: int = RANGE, damaged: bool = False) -> DataFrame:
    """Every record that the chain from its file's start reaches, in columns RECORD.

    A chain that ends before its file does (a truncated or damaged record, or a header over HEADER bytes)
    raises, with the file and offset; with ``damaged`` the records before that are read, and
    ``broken_chains`` lists the rest. Length and digest are taken from the payload, and a payload that
    doesn't match its SHA-1 raises; a revisit's are those its header states, null where it states none.
    page_id and refers_to are known for records that ``write_warc`` wrote; record_id and refers_to_id are
    the header's own. Without ``payloads`` that column is null. ``manifest`` needs path and bytes; files
    ending in .gz hold a gzip member a record. No files, no rows.
    """
    entries = written(_followed(manifest, size), "entries")
    if not damaged and (bad := _broken(entries, manifest).orderBy("path").limit(5).collect()):
        raise ValueError("records break off: " + "; ".join(f"{r.path} at {r.offset} of {r.bytes}" for r in bad))
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader, at, end = _Reader(r["path"]), r["at"], r["a"] + size
                take = reader.packed if r["path"].endswith(".gz") else reader.plain
                rows, weight = [], 0
                while at < min(end, reader.size) and (found := take(at, True)):
                    row = _parsed(found[0])
                    rows.append(row if payloads else (*row[:6], None, *row[7:]))
                    weight += len(found[0])
                    at = found[1]
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, weight = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return entries.select("path", "a", "at").repartition(parts).mapInArrow(freeing(run), RECORD)
