"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.blocks import join_hot
from gridloom.llm.store import written

NGRAM, THRESHOLD = 5, 0.8
#: Fingerprints of 64 bits in BLOCKS blocks: within RADIUS, some block differs in RADIUS // BLOCKS bits at most.
BLOCKS, RADIUS = 8, 23
WORD = r"[\p{L}\p{N}]+"
#: Bits of the table of benchmark shingles that every task holds: so many a shingle, within these bounds. A fuller table lets more through, never less.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
#: Rows of ids or of the index that may be broadcast, to leave texts or windows out of a shuffle; beyond it they are shuffled.
SENT_IDS = 2_000_000


def words(text: Column) -> Column:
    """A text's runs of letters and digits in lower case; null is empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(n)])


def _places(w: Column, n: int) -> Column:
    """The positions at which an n-gram starts; none in a text of fewer words."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))


def shingles(w: Column, n: int = NGRAM) -> Column:
    """The hashes of all n-grams of words, in order, repeated ones too."""
    return F.transform(_places(w, n), lambda i: _gram(w, i, n))


def simhash(grams: Column) -> Column:
    """A fingerprint: bit b is set where more shingles than not, each as often as it occurs, have bit b."""
    zero = F.array_repeat(F.lit(0), 64)
    sums = F.aggregate(grams, zero, lambda acc, h: F.transform(acc, lambda x, b: x + F.getbit(h, b).cast("int") * 2 - 1))
    bits = F.transform(sums, lambda x, b: F.when(x > 0, F.lit("1")).otherwise(F.lit("0")))
    return F.conv(F.array_join(F.reverse(bits), ""), 2, -10).cast("bigint")


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle arrays, a shingle's weight being its count: sum of minima over sum of maxima."""

    def times(x: Column, h: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == h))

    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def _listed(spark: SparkSession, grams: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test of a hash by a bit table of ``n`` shingles (a column h), held as a scalar subquery: no listed shingle fails it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()))
    low = F.col("h").bitwiseAND(bits - 1)
    ones = grams.select(F.shiftright(low, 6).cast("int").alias("i"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))").alias("bits"))
    none = spark.range(bits // 64, numPartitions=1).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("bigint").alias("bits"))
    words_ = ones.union(none).groupBy("i").agg(F.bit_or("bits").alias("bits"))
    table = words_.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bits"))), lambda x: x["bits"])).scalar()

    def listed(h: Column) -> Column:
        at = h.bitwiseAND(bits - 1)
        return F.getbit(F.element_at(table, F.shiftright(at, 6).cast("int") + 1), at.bitwiseAND(63).cast("int")) == 1

    return listed


def _digest(grams: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(grams.cast("array<string>"), " "), 256))


def _sent(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows, broadcast if they are few enough."""
    return F.broadcast(df) if n <= SENT_IDS else df


def _variants(blocks: int, most: int) -> Column:
    """Every change of at most ``most`` bits to a block, as masks to xor with it."""
    size = 64 // blocks
    return F.array(*[F.lit(m) for m in range(1 << size) if m.bit_count() <= most])


def _blocks(fingerprint: Column, blocks: int) -> Column:
    size = 64 // blocks
    return F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda i: F.struct(i.alias("block"), F.call_function("shiftrightunsigned", fingerprint, (i * size).cast("int")).bitwiseAND((1 << size) - 1).alias("value")),
    )


def _windows(docs: DataFrame, placed: DataFrame, threshold: float, n: int) -> DataFrame:
    """(id, windows): the places of all item-sized windows that can have the threshold's similarity to an item.

    A similarity of ``threshold`` takes a least number of shingles in common, so a window with fewer
    shingles of items of its length can't have it; every other window is listed. ``placed`` has the
    shingles h of items by the items' length n; ``docs`` has id and text.
    """
    shingled = written(placed.distinct(), "placed")
    count = shingled.count()
    listed = _listed(docs.sparkSession, shingled.select("h").distinct(), count)
    rows = docs.select("id", words(F.col("text")).alias("w"))
    hits = rows.select("id", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), n)).alias("p", "h")).where(listed(F.col("h")))
    shared = hits.join(_sent(shingled, count), "h").groupBy("id", "size", "n").agg(F.array_sort(F.collect_set("p")).alias("at"))
    # Both sides' shingles, of which threshold / (1 + threshold) must be common ones.
    held = F.least("size", "n") - (n - 1)
    least = F.greatest(F.lit(1), F.ceil((held + F.col("n") - (n - 1)) * (threshold / (1 + threshold)) - 1e-9).cast("int"))
    shared = shared.withColumn("held", held).withColumn("least", least).where(F.size("at") >= F.col("least"))
    # Any ``least`` shingles in a row that fit into one window: the starts of all windows that hold them.
    runs = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("least")), lambda i: F.struct(F.get("at", i).alias("a"), F.get("at", i + F.col("least") - 1).alias("b")))
    first = lambda x: F.greatest(F.lit(0), x["b"] - F.col("held") + 1)
    last = lambda x: F.least(x["a"], F.greatest(F.lit(0), F.col("size") - F.col("n")))
    fit = F.transform(F.filter(runs, lambda x: first(x) <= last(x)), lambda x: F.sequence(first(x), last(x)))
    starts = shared.select("id", "size", "n", F.explode(F.array_distinct(F.flatten(fit))).alias("start"))
    return written(starts.groupBy("id").agg(F.collect_list(F.struct("start", "n", "size")).alias("windows")), "windows")


def _prints(docs: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(id, start, n, window, print, grams): each window with its fingerprint and, as ``window``, a digest of its shingles."""
    ids = windows.select("id")
    some = docs.join(_sent(ids, windows.count()), "id", "left_semi")
    # Words first: shingles refer to them at every position, so they must be a column, not an expression.
    grams = some.join(windows, "id").select("id", "windows", words(F.col("text")).alias("w")).select("id", "windows", F.size("w").alias("size"), shingles(F.col("w"), n).alias("grams"))
    # Rows that repeat a key have windows of their own lengths.
    cut = grams.select("id", F.explode(F.filter("windows", lambda x: x["size"] == F.col("size"))).alias("x"), "grams")
    cut = cut.select("id", "x.start", "x.n", F.expr(f"slice(grams, x.start + 1, x.n - {n - 1})").alias("grams")).where(F.size("grams") > 0)
    return written(cut.select("id", "start", "n", _digest(F.col("grams")).alias("window"), simhash(F.col("grams")).alias("print"), "grams"), "prints")


def _near(windows: DataFrame, classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(window, class): all pairs of one length whose fingerprints differ in ``radius`` bits at most, by the index of blocks."""
    lookup = classes.select("n", "class", F.col("print").alias("item_print"), F.explode(_blocks(F.col("print"), blocks)).alias("b"))
    lookup = lookup.select("n", "class", "item_print", "b.block", F.explode(F.transform(_variants(blocks, radius // blocks), lambda m: F.col("b.value").bitwiseXOR(m))).alias("value"))
    lookup = written(lookup, "lookup")
    asked = windows.select("window", "n", "print", F.explode(_blocks(F.col("print"), blocks)).alias("b")).select("window", "n", "print", "b.block", "b.value")
    pairs = asked.join(_sent(lookup, lookup.count()), ["n", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    return written(pairs.select("window", "class").distinct(), "pairs")


def _found(docs: DataFrame, items: DataFrame, threshold: float, n: int, radius: int, blocks: int) -> DataFrame:
    """(id, item, similarity, start, n) of ``docs`` (id, text) and ``items`` (item, text), each pair's best window."""
    spark = docs.sparkSession
    split = items.select("item", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    # A shingle beyond the last word hashes the words there are.
    grams = F.when(F.size("w") >= n, shingles(F.col("w"), n)).otherwise(F.array(_gram(F.col("w"), F.lit(0), n)))
    index = written(split.select("item", F.size("w").alias("n"), grams.alias("grams")).withColumn("class", _digest(F.concat(F.array(F.col("n").cast("bigint")), F.col("grams")))), "items")
    classes = index.groupBy("class").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    classes = written(classes.withColumn("print", simhash(F.col("grams"))), "classes")
    long, short = classes.where(F.col("n") >= n), classes.where(F.col("n") < n)

    windows = _windows(docs, long.select("n", F.explode("grams").alias("h")), threshold, n)
    prints = _prints(docs, windows, n)
    # Copies hold the same windows, so each is looked up and compared once.
    unlike = prints.groupBy("window", "n").agg(F.first("print").alias("print"), F.first("grams").alias("grams"), F.count(F.lit(1)).alias("size"))
    unlike = written(unlike, "unlike")
    pairs = _near(unlike, long, radius, blocks)
    both = pairs.join(unlike.select("window", "size", F.col("grams").alias("a")), "window").join(long.select("class", F.col("n").alias("item_n"), F.col("grams").alias("b")), "class")
    similar = both.select("window", "size", "class", weighted_similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= threshold)
    held = join_hot(prints.select("id", "start", "n", "window"), written(similar, "similar"), "window", prints.count())
    best = held.groupBy("id", "class").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n")).alias("best"))
    found = best.select("id", "class", "best.similarity", (-F.col("best.s")).alias("start"), "best.n")

    for k in sorted(r.n for r in short.select("n").distinct().collect()):
        # One shingle, the whole item: its fingerprint is the shingle's own hash, and equal ones are the item.
        own = short.where(F.col("n") == k).select("class", F.get("grams", F.lit(0)).alias("h"))
        count = own.count()
        listed = _listed(spark, own.select("h"), count)
        rows = docs.select("id", words(F.col("text")).alias("w"))
        hits = rows.select("id", F.posexplode(shingles(F.col("w"), k)).alias("p", "h")).where(listed(F.col("h"))).groupBy("id", "h").agg(F.min("p").alias("start"))
        equal = hits.join(_sent(own, count), "h")
        found = found.unionByName(equal.select("id", "class", F.lit(1.0).alias("similarity"), "start", F.lit(k).alias("n")))
    return found.join(_sent(index.select("class", "item"), index.count()), "class").drop("class")


def contaminations(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, threshold: float = THRESHOLD, n: int = NGRAM, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(key, item, similarity, start_word, n_words): each document with each item that it holds.

    An item is held where a window of as many words (the whole text, if that is shorter) has a weighted
    Jaccard similarity of word n-grams of ``threshold`` or more; the row names the best window, of equal
    ones the first. All windows of whole texts that can reach the threshold, by the number of the items'
    shingles in them, are fingerprinted by SimHash and looked up in an index of the items' fingerprints
    that returns all within ``radius`` bits; similarity is then computed exactly. An item of fewer than
    ``n`` words is one shingle and is held where just its words stand. Null items and those without words
    match nothing, nor do texts of fewer words than a shingle. Rows without a key are left out; of rows
    that repeat a key, each is searched. Repeated items are found alike. Empty tables give no rows. Where
    both tables' keys have one name, the item's column is ``item_`` and that name.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    found = _found(rows, items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text")), threshold, n, radius, blocks)
    named = f"item_{item_key}" if item_key.lower() == key.lower() else item_key
    return found.select(F.col("id").alias(key), F.col("item").alias(named), "similarity", F.col("start").alias("start_word"), F.col("n").alias("n_words"))


def decontaminated(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, **options) -> DataFrame:
    """``docs`` without those that hold an item; rows without a key stay, and all columns are as they were."""
    found = contaminations(docs, key, text, items.select(F.col(item_key).alias("__item"), F.col(item_text).alias("__text")), "__item", "__text", **options)
    gone = written(found.select(F.col(key).alias("__gone")).distinct(), "gone")
    return docs.join(_sent(gone, gone.count()), docs[key] == gone["__gone"], "left_anti")
