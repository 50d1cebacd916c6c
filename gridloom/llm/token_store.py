"""Token ids in binary shards: one zstandard frame a document, one shared dictionary.

A shard file is: HEAD (magic, bytes an id takes, SHA-256 of the dictionary), the documents' frames, an
index (id known, id, ids in the document, offset of its frame), TAIL (offset and length of the index,
its crc32, magic). Documents are in ascending id order inside a shard and across shard numbers.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.store import filesystem, freeing, new_path, written

HEAD = "<8sB7x32s"
TAIL = "<QQI4x8s"
MAGIC = b"GLTOKEN1"
INDEX = np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<u8"), ("at", "<u8")])
#: Chunks that a process remembers; a slice that finds the cache full starts it anew.
CACHE = 250_000
#: Texts that keep their chunks as they are hold other letters, marks of special tokens, or a mark before a final point or comma.
TRICKY = r"[^\x00-\x{12f}\x{131}-\x{24f}]|<\||[^\s\pL\pN][.,](?:\s|$)"
#: Characters of texts that are encoded together.
STEP = 8 << 20
DICTIONARY_BYTES = 32_768
#: The dictionary is trained on so many documents of lowest hash, a span of so many characters of each; it affects sizes only.
SAMPLE_DOCS, SAMPLE_CHARS = 1024, 16_384

_tokenizers: dict[tuple[str, bool], "WordTokenizer"] = {}


class WordTokenizer:
    """The tokenizers library behind a cache of white-space-separated chunks.

    The tokenizer must drop white space before it splits words, so that a text's ids are those of its
    chunks joined. In texts of letters below U+0250, where lowering goes letter by letter and NFC changes
    nothing, chunks are looked up in lower case, and a point or comma that ends a word apart from it.
    New words go to the library together, other new chunks one by one. The strings of special tokens in a
    text become those tokens' ids, as the library has it, unless ``special_as_text``.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        vocabulary = self.library.get_vocab()
        size = max(vocabulary.values()) + 1
        self.width = 2 if size <= 1 << 16 else 4
        self.last = np.zeros(size, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.plain = regex.compile("[\0-įı-ɏ]*")
        self.chunks: dict[str, bytes] = {"": b""}

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _alone(self, chunk: str) -> bytes:
        return self._raw(self.library.encode(chunk, add_special_tokens=False).ids)

    def _learn_words(self, new: list[str]) -> None:
        """The library encodes new words in one text; a word's ids end at its word-end token."""
        ids = np.array(self.library.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(new) and ends[-1] == len(ids):
            raw = ids.astype(f"<u{self.width}").tobytes()
            at = [0, *(self.width * ends).tolist()]
            self.chunks.update((p, raw[a:b]) for p, a, b in zip(new, at, at[1:]))
        else:
            for p in new:
                self.chunks[p] = self._alone(p)

    def _learn(self, new: list[str]) -> None:
        words, split = set(), {}
        for c in new:
            if c.isalpha() and c.islower() and self.plain.fullmatch(c):
                words.add(c)
            elif "<|" in c or not self.plain.fullmatch(c):
                self.chunks[c] = self._alone(c)
            else:
                split[c] = self.words.findall(c.lower())
                words.update(split[c])
        get = self.chunks.get
        if missing := [p for p in words if get(p) is None]:
            self._learn_words(missing)
        for c, ps in split.items():
            self.chunks[c] = b"".join(map(get, ps))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after another, and where each text's end; null is empty."""
        t = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        easy = pc.utf8_lower(pc.binary_join_element_wise(t, "", " "))
        easy = pc.replace_substring(pc.replace_substring(easy, ". ", " . "), ", ", " , ")
        parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(t, TRICKY), t, easy), " ")
        if isinstance(parts, pa.ChunkedArray):
            parts = parts.combine_chunks()
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.chunks) > CACHE:
            self.chunks.clear()
            self.chunks[""] = b""
        ids = list(map(self.chunks.get, chunks))
        if None in ids:
            self._learn([c for c, x in zip(chunks, ids) if x is None])
            ids = [self.chunks[c] if x is None else x for c, x in zip(chunks, ids)]
        pool = np.frombuffer(b"".join(ids), f"<u{self.width}")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = size[code]
        end = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[code] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
        last = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        return pool[at], np.append(0, end)[last]

    def encode(self, text: str | None) -> bytes:
        """Serialized ids of one text, in ``width`` bytes each."""
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()


def tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    """The tokenizer of a file; a process keeps the last one."""
    if (path, special_as_text) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path, special_as_text] = WordTokenizer(path, special_as_text)
    return _tokenizers[path, special_as_text]


def train_dictionary(df: DataFrame, key: str, text: str, path: str, end_id: int, special_as_text: bool = False) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample of documents; empty if there are too few.

    Only keys are ordered to choose the sample; of each of its texts one span comes to the driver, at a
    place that the key's hash tells: no more than SAMPLE_DOCS times SAMPLE_CHARS characters in all,
    whatever the table's size.
    """
    import zstandard

    k = F.col(key)
    some = df.where(k.isNotNull()).select(k.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_DOCS).distinct()
    at = F.pmod(F.xxhash64(k, F.lit(2)), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    texts = df.select(k.alias("k"), F.col(text).substr(at, F.lit(SAMPLE_CHARS)).alias("t")).join(F.broadcast(some), "k", "left_semi")
    rows = texts.groupBy("k").agg(F.min("t").alias("t")).orderBy("k").collect()
    enc = tokenizer(path, special_as_text)
    samples = [enc.encode(r.t) + end_id.to_bytes(enc.width, "little") for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold about STEP bytes: each new word is looked up once in them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= STEP:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _encoded(enc: WordTokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, ids and ends of slices of rows, of about STEP characters or one text each."""
    for table in _joined(batches):
        size = np.cumsum(pc.fill_null(pc.binary_length(table.column(1)), 0).to_numpy())
        a = 0
        while a < table.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + 2 * STEP, "right")))
            part = table.slice(a, b - a)
            yield (part.column(0).to_pylist(), *enc.encode_batch(part.column(1).combine_chunks()))
            a = b


def write_tokens(df: DataFrame, key: str, text: str, path: str, end_id: int, folder: str | None = None, level: int = 3, special_as_text: bool = False) -> DataFrame:
    """Encodes every whole text and writes shards to a shared folder; returns their manifest.

    Manifest: part, path, dictionary, n_docs, n_tokens, bytes, start (ids before the shard). Each
    document's ids end with ``end_id``. A null text is empty; a null key is kept and comes first; rows of
    equal keys stay rows of their own, ordered by a hash of the text, then by the text. An empty table
    writes no shards. Special tokens' strings in texts become their ids, unless ``special_as_text``. A task
    writes under a name of its own and moves the file when it is whole, so a task that runs again replaces it.
    """
    spark = df.sparkSession
    root = folder or new_path(spark, "tokens")
    raw = train_dictionary(df, key, text, path, end_id, special_as_text)
    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary") as f:
        f.write(raw)
    sent = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = tokenizer(path, special_as_text)
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(sent.value)).compress
        end = end_id.to_bytes(enc.width, "little")
        part = TaskContext.get().partitionId()
        fs, base = filesystem(root)
        out, index, at, total = None, [], struct.calcsize(HEAD), 0
        own = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
        for keys, ids, ends in _encoded(enc, batches):
            if out is None:
                out = fs.open_output_stream(own)
                out.write(struct.pack(HEAD, MAGIC, enc.width, hashlib.sha256(sent.value).digest()))
            raw, a = ids.tobytes(), 0
            for i, b in zip(keys, (ends * enc.width).tolist()):
                frame = pack(raw[a:b] + end)
                out.write(frame)
                index.append((i is not None, i or 0, (b - a) // enc.width + 1, at))
                at += len(frame)
                total += (b - a) // enc.width + 1
                a = b
        if out is None:
            return
        table = np.array(index, INDEX).tobytes()
        out.write(table)
        out.write(struct.pack(TAIL, at, len(index), zlib.crc32(table), MAGIC))
        out.close()
        final = f"{base}/part-{part:06d}.tok"
        fs.move(own, final)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int64()), "path": [f"{root}/part-{part:06d}.tok"], "dictionary": [f"{root}/dictionary"], "n_docs": pa.array([len(index)], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "bytes": pa.array([at + len(table) + struct.calcsize(TAIL)], pa.int64())}
        )

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    place = F.xxhash64("t")
    sorted_rows = rows.repartitionByRange("k", place).sortWithinPartitions("k", place, "t")
    manifest = written(sorted_rows.mapInArrow(freeing(run), "part long, path string, dictionary string, n_docs long, n_tokens long, bytes long"), "manifest")
    return manifest.withColumn("start", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


class Shard:
    """One shard file: its index, and any document by its place in it."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        import zstandard

        fs, p = filesystem(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        head = self.file.read_at(struct.calcsize(HEAD), 0)
        magic, self.width, digest = struct.unpack(HEAD, head)
        at, n, crc, tail = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        table = self.file.read_at(n * INDEX.itemsize, at)
        if magic != MAGIC or tail != MAGIC or zlib.crc32(table) != crc:
            raise ValueError(f"{path} is no whole shard")
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{path} was written with another dictionary")
        self.index = np.frombuffer(table, INDEX)
        self.ends = np.append(self.index["at"][1:], at)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, i: int, frame: bytes | None = None) -> np.ndarray:
        """The ids of the shard's i-th document."""
        a = int(self.index["at"][i])
        frame = self.file.read_at(int(self.ends[i]) - a, a) if frame is None else frame
        return np.frombuffer(self.unpack(frame, max_output_size=int(self.index["n"][i]) * self.width), f"<u{self.width}")

    def __iter__(self) -> Iterator[np.ndarray]:
        """All documents' ids in order, read in spans of about 4 MB."""
        i, n = 0, len(self.index)
        while i < n:
            a = int(self.index["at"][i])
            j = max(i + 1, int(np.searchsorted(self.ends, a + (4 << 20))))
            span = self.file.read_at(int(self.ends[j - 1]) - a, a)
            for k in range(i, j):
                yield self.ids(k, span[int(self.index["at"][k]) - a : int(self.ends[k]) - a])
            i = j


def _open(path: str, dictionary: str) -> Shard:
    fs, p = filesystem(dictionary)
    with fs.open_input_file(p) as f:
        return Shard(path, f.read())


def read_tokens(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids array<int>) of every document in the shards, a task a shard.

    With ``digests``, ids_crc32 takes the place of ids: the unsigned crc32 of the document's ids as
    little-endian unsigned 32-bit integers. ``start`` counts the ids of all documents before it.
    """
    last = "ids_crc32 long" if digests else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _open(row["path"], row["dictionary"])
                index = shard.index
                n = index["n"].astype(np.int64)
                start = row["start"] + np.cumsum(n) - n
                key = pa.array(index["id"], mask=index["known"] == 0)
                held, a, weight = [], 0, 0
                for i, ids in enumerate(shard):
                    ids = ids.astype("<u4")
                    held.append(zlib.crc32(ids.tobytes()) if digests else ids)
                    weight += len(ids)
                    if weight > 1 << 20 or i + 1 == len(index):
                        if digests:
                            col = pa.array(held, pa.int64())
                        else:
                            col = pa.ListArray.from_arrays(np.cumsum([0, *map(len, held)]).astype(np.int32), np.concatenate(held).astype(np.int32))
                        b = i + 1
                        yield pa.RecordBatch.from_arrays([key.slice(a, b - a), pa.array(start[a:b]), pa.array(n[a:b]), col], ["id", "start", "n_tokens", last.split()[0]])
                        held, a, weight = [], b, 0

    shards = manifest.select("path", "dictionary", "start")
    return shards.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(freeing(run), f"id long, start long, n_tokens long, {last}")


def read_document(manifest: DataFrame, key: int) -> list[int] | None:
    """The ids of one document by its key through the offset indexes; None where no shard holds it."""
    for row in manifest.select("path", "dictionary").collect():
        shard = _open(row.path, row.dictionary)
        at = np.flatnonzero((shard.index["id"] == key) & (shard.index["known"] == 1))
        if len(at):
            return shard.ids(int(at[0])).tolist()
    return None
