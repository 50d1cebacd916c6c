"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.blocks import chunk_pairs, counted_here, dealt, join_hot, leads, led, local_roots, runs
from gridloom.llm.components import connected_components
from gridloom.llm.store import freeing, written

NGRAM, THRESHOLD, RECALL, HASHES, SEED = 5, 0.8, 0.9999, 80, 20240301
BLOCK = 256
SLAB = 8192
#: Ids that may be broadcast to leave other documents' texts out of a shuffle; beyond it the texts are shuffled.
SENT_IDS = 2_000_000
WORD = r"[\p{L}\p{N}]+"
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band that reach ``recall`` at the threshold within ``hashes`` hashes, and the bands they need."""
    best = None
    for rows in range(1, hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit > 1e-12 else hashes + 1
        if bands * rows > hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("that recall needs more hashes")
    return best


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words, in order: runs of letters and digits, lower case; null is empty."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def ngram_set(words: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams. A text of fewer words has one, of all its words; one of none has none."""
    if not len(words):
        return np.array([], np.uint64)
    w = words.view(np.uint64)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * ODD + w[i : len(w) - k + 1 + i]
    return np.unique(_mixed(h))


def _sketch(grams: np.ndarray, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), SLAB):
        low = np.minimum(low, (grams[i : i + SLAB, None] * a + b >> np.uint64(20)).min(0))
    h = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        h = _mixed(h * ODD + low.reshape(bands, rows)[:, r])
    return h.view(np.int64)


def shared_grams(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each of ``left`` shares with each of ``right``; grams of one set only are left out, the rest taken in slabs."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    keep = several[gram]
    owner, gram = owner[keep], number[gram[keep]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((len(left), len(right)), np.int64)
    total = int(number[-1]) + 1 if len(number) else 0
    for a in range(0, total, SLAB):
        i, j = np.searchsorted(gram, [a, a + SLAB])
        held = np.zeros((len(sets), min(SLAB, total - a)), np.float32)
        held[owner[i:j], gram[i:j] - a] = 1
        out += (held[left] @ held[right].T).astype(np.int64)
    return out


def jaccard_join(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, hashes: int = HASHES, seed: int = SEED) -> DataFrame:
    """One row a document: key, class_id, n_links, component_id, kept.

    Documents link when their sets of word n-grams have a Jaccard similarity of ``threshold`` or more.
    Documents of equal sets are one class, named by its smallest key; classes are compared, and n_links
    counts all other documents linked to a document, its class's included. component_id is the smallest
    key reachable by links; kept marks one document of each component. Texts without words (null and
    empty ones too) link with nothing. Rows without a key have 0 links and null ids; a key that occurs
    with several texts is one node. An empty table gives no rows.

    A document is sent once for each leader (smallest class) among its buckets, not for each bucket, and a
    link is counted where the smallest of the leaders that both share has them meet. Large groups are cut
    into chunks whose pairs are dealt out, so links are counted, never listed.
    """
    bands, rows = bands_for(threshold, recall, hashes)
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cells = [], []
            for x in batch.column(1):
                grams = ngram_set(x.values.to_numpy(), n)
                digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None
                keys.append(digest)
                cells.append(_sketch(grams, bands, rows, a, b) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["id", "set", "bands"])

    sketch = written(docs.select("id", word_hashes(F.col("text")).alias("w")).mapInArrow(freeing(sketched), "id long, set binary, bands array<bigint>"), "sketch")
    known = sketch.where("set is not null and id is not null")
    classes = written(known.groupBy("set").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "classes")
    members = written(led(classes, "set", "bands"), "members")
    ids = members.select(F.col("rep").alias("id")).distinct()
    some = docs.join(F.broadcast(ids) if members.count() <= SENT_IDS else ids, "id", "left_semi")
    texts = some.select("id", word_hashes(F.col("text")).alias("w")).join(members, F.col("id") == F.col("rep"))

    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("t", pa.int32()), ("g", pa.int64())])), pa.list_(pa.struct([("g", pa.int64()), ("size", pa.int64())])), pa.binary()]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows_ = []
                for rep, set_, n_, gs, groups, w in zip(*(part.column(c) for c in ("rep", "set", "n", "gs", "groups", "w"))):
                    grams = ngram_set(w.values.to_numpy(), n)
                    if hashlib.blake2b(grams.tobytes(), digest_size=16).digest() != set_.as_py():
                        continue  # another text under the same key
                    rows_.append((rep.as_py(), set_.as_py(), n_.as_py(), gs.as_py(), groups.as_py(), grams.tobytes()))
                if rows_:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), kinds)], ["rep", "set", "n", "gs", "groups", "grams"])

    schema = "rep long, set binary, n long, gs array<struct<t:int,g:bigint>>, groups array<struct<g:bigint,size:bigint>>, grams binary"
    full = texts.select("rep", "set", "n", "gs", "groups", "w").mapInArrow(freeing(gathered), schema).dropDuplicates(["set"])
    dealt_rows = full.withColumn("group", F.explode("groups")).withColumn("pair", F.explode(chunk_pairs(F.col("set"), F.col("group.size"), BLOCK)))
    dealt_rows = dealt_rows.select("group.g", "pair.a", "pair.b", "pair.own", "rep", "set", "n", "gs", "grams")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["g", "a", "b"]):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks().sort_by("rep")
            g, a_, b_ = (group.column(c)[0].as_py() for c in ("g", "a", "b"))
            own = group.column("own").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
            lead, has = leads(group.column("gs").combine_chunks(), bands)
            left, right = np.flatnonzero(own == a_), np.flatnonzero(own == b_)
            if not len(left) or not len(right):
                continue
            both = shared_grams(sets, left, right)
            count = np.array([len(s) for s in sets])
            i, j = np.nonzero(both / (count[left][:, None] + count[right] - both) >= threshold)
            i, j = left[i], right[j]
            if a_ == b_:
                i, j = i[i < j], j[i < j]
            here = counted_here(lead, has, i, j, g)
            i, j = i[here], j[here]
            if not len(i):
                continue
            n_, rep = group.column("n").to_numpy(), group.column("rep").to_numpy()
            links = np.zeros(len(sets), np.int64)
            np.add.at(links, i, n_[j])
            np.add.at(links, j, n_[i])
            root = rep[local_roots(len(sets), i, j)]
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), group.column("set").combine_chunks().take(pa.array(at)), pa.array(links[at]), pa.array(root[at])], ["rep", "set", "links", "root"])

    found = written(dealt(dealt_rows, ["g", "a", "b"]).mapInArrow(freeing(linked), "rep long, set binary, links long, root long"), "links")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    edges = found.select("rep", "root")
    if known.groupBy("id").agg(F.count_distinct("set").alias("sets")).where("sets > 1").limit(1).count():
        edges = edges.union(known.join(classes, "set").where("id <> rep").select("id", "rep"))
    parts = connected_components(edges, "rep", "root")
    by_class = classes.select("set", "rep", "n").join(links, "set", "left")
    by_class = by_class.join(parts, by_class["rep"] == parts["node"], "left").select(
        "set", F.col("n").alias("size"), F.col("rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    by_class = written(by_class, "by_class")
    linked_rows = join_hot(known.select("id", "set"), by_class, "set", sketch.count()).select("id", "class_id", "n_links", "component_id")
    alone = sketch.where("set is null or id is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked_rows.unionByName(alone)
    return out.select(
        F.col("id").alias(key),
        "class_id",
        F.col("n_links").cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def one_of_each(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """``df`` without the documents that another of their component stands for; rows without a key stay."""
    joined = jaccard_join(df, key, text, **options)
    gone = written(joined.where(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("__gone")).distinct(), "gone")
    few = gone.count() <= SENT_IDS
    return df.join(F.broadcast(gone) if few else gone, df[key].cast("bigint") == gone["__gone"], "left_anti")
