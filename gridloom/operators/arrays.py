"""Array patterns: rows and columns by gaps and islands, filled areas by connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.intervals import distance_to_contact, distance_to_touch, within
from gridloom.operators.classify import merged, static_fields
from gridloom.operators.clusters import DISTANCES, connected, divided
from gridloom.plans.grammar import THRESHOLD, Pattern
from gridloom.plans.ranges import Span


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in "ltrb"])


def line_islands(items: DataFrame, keys: list[str], direction: str, gap: Span, kind: str = "corner") -> DataFrame:
    """Adds ``line`` (the cross coordinates) and ``island``: runs of items on one line whose neighbours are ``gap`` apart.

    Only window functions: one shuffle by keys and line.
    """
    cross, lead = (("t", "b"), "l") if direction == "row" else (("l", "r"), "t")
    w = Window.partitionBy(*keys, *cross).orderBy(lead, "pord", "ord", "match_id")
    before = F.lag(_box()).over(w)
    distance = (distance_to_touch if kind == "corner" else distance_to_contact)(F.col("before"), _box())
    marked = items.withColumn("before", before).withColumn("break", F.when(F.col("before").isNull(), 1).when(within(distance, gap), 0).otherwise(1))
    return marked.withColumn("line", F.struct(*cross)).withColumn("island", F.sum("break").over(w)).withColumn("seq", F.row_number().over(w)).drop("before", "break")


def _collected(clusters: DataFrame, by: list[str]) -> DataFrame:
    """One row a cluster, its members in order."""
    member = F.struct("seq", "match_id", "content", "precision", "ord")
    return clusters.groupBy(*by).agg(
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n"), F.avg("precision").alias("mean"), F.min("ord").alias("ord"), F.array_sort(F.collect_list(member)).alias("items")
    )


def _fits(p: Pattern) -> Column:
    ok = within(F.col("n"), p.item_count)
    return ok & p.size.holds(_box()) if p.size else ok


def _lines(items: DataFrame, keys: list[str], p: Pattern, direction: str) -> DataFrame:
    marked = line_islands(items, keys, direction, p.gap, p.distance_kind)
    return _collected(marked, [*keys, "line", "island"]).where(_fits(p)).drop("line", "island")


def _runs(boxes: list, p: Pattern, direction: str) -> list[list[int]]:
    """Runs along lines, as ``line_islands`` finds them, for groups that are broken down afterwards."""
    cross, lead = ((1, 3), 0) if direction == "row" else ((0, 2), 1)
    on: dict[tuple, list[int]] = {}
    for i, b in enumerate(boxes):
        on.setdefault((b[cross[0]], b[cross[1]]), []).append(i)
    out = []
    for who in on.values():
        who.sort(key=lambda i: (boxes[i][lead], i))
        run = [who[0]]
        for i, j in zip(who, who[1:]):
            if DISTANCES[p.distance_kind](boxes[i], boxes[j]) in p.gap:
                run.append(j)
            else:
                out.append(run)
                run = [j]
        out.append(run)
    return out


def _kernel(p: Pattern, keys: list[str], direction: str):
    size = (p.size.width, p.size.height) if p.size else None

    def parts(boxes: list) -> list[list[int]]:
        raw = connected(boxes, p.gap, p.distance_kind) if direction == "fill" else _runs(boxes, p, direction)
        return [s for c in raw for s in divided(boxes, c, p.item_count, size, p.allow_breakdown, p.gap, p.distance_kind)]

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Clusters of whole groups, which lie one after another in order."""
        who = list(zip(*(table.column(k).to_pylist() for k in keys)))
        boxes = list(zip(*(table.column(c).to_pylist() for c in "ltrb")))
        rows: list[int] = []
        cluster: list[int] = []
        seq: list[int] = []
        a = 0
        while a < len(who):
            b = a + 1
            while b < len(who) and who[b] == who[a]:
                b += 1
            for k, part in enumerate(parts(boxes[a:b])):
                rows += [a + i for i in part]
                cluster += [k] * len(part)
                seq += range(len(part))
            a = b
        if rows:
            out = table.take(pa.array(rows, pa.int64()))
            out = out.append_column("cluster", pa.array(cluster, pa.int64())).append_column("seq", pa.array(seq, pa.int64()))
            yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the batches of the group that isn't over yet; each batch's keys are looked at once."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            who = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
            cut = len(who) - 1
            while cut and who[cut - 1] == who[-1]:
                cut -= 1
            if cut or who[0] != last:
                whole = [*held, batch.slice(0, cut)] if cut else held
                if whole:
                    yield from done(pa.Table.from_batches(whole))
                held = []
            held.append(batch.slice(cut))
            last = who[-1]
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def _grouped(items: DataFrame, keys: list[str], p: Pattern, direction: str) -> DataFrame:
    """Clusters of one group at a time; a group is the items of one sheet, or of one partial match."""
    items = items.select(*keys, "match_id", "pord", "ord", "l", "t", "r", "b", "precision", "content")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema) + ", cluster long, seq long"
    lined = items.repartition(*keys).sortWithinPartitions(*keys, "pord", "ord", "match_id")
    return _collected(lined.mapInArrow(_kernel(p, keys, direction), schema), [*keys, "cluster"]).drop("cluster")


def clusters(items: DataFrame, keys: list[str], p: Pattern) -> DataFrame:
    """(keys, l, t, r, b, n, mean, ord, items): the clusters of each group by the pattern's direction.

    ``auto`` takes rows or columns, whichever gives a group fewer clusters (rows if as many). Rows and
    columns without breakdown stay in SQL; connected groups and breakdown run a group at a time in Python.
    """
    if p.direction == "fill":
        return _grouped(items, keys, p, "fill")
    one = (lambda d: _grouped(items, keys, p, d)) if p.allow_breakdown else (lambda d: _lines(items, keys, p, d))
    if p.direction in ("row", "column"):
        return one(p.direction)
    both = one("row").withColumn("way", F.lit(0)).unionByName(one("column").withColumn("way", F.lit(1)))
    w = Window.partitionBy(*keys, "way")
    sized = both.withColumn("many", F.count(F.lit(1)).over(w))
    best = F.min(F.struct("many", "way")).over(Window.partitionBy(*keys))
    return sized.withColumn("best", best).where("way = best.way").drop("way", "many", "best")


def array_matches(items: DataFrame, p: Pattern, keys: list[str] | None = None) -> DataFrame:
    """Matches of an array pattern among its items (with pord, ord, match_id, box, precision, content).

    The precision is the mean of the items' times 1 - 0.5/n. A group of a single item is an array of it
    with its own precision, if the pattern's size allows it. Groups of fewer items than item_count asks
    for have none, nor do groups without items.
    """
    keys = keys or ["doc_id"]
    counted = items.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    enough = counted.where(F.col("total") >= (p.item_count.start or 0))
    several = clusters(enough.where("total > 1").drop("total"), keys, p)
    several = several.withColumn("score", F.col("mean") * (1 - 0.5 / F.col("n")))
    single = _collected(enough.where("total = 1").drop("total").withColumn("seq", F.lit(0).cast("long")), keys).withColumn("score", F.col("mean"))
    if p.size:
        single = single.where(p.size.holds(_box()))
    kind = dict(several.dtypes)["items"]
    found = several.withColumn("items", F.col("items").cast(kind)).unionByName(single.withColumn("items", F.col("items").cast(kind)))
    ids = F.transform("items", lambda x: x["match_id"])
    shown = F.transform("items", lambda x, i: merged(x["content"], [("@index_in_array", (i + 1).cast("string"))] if p.index_items else []))
    return found.where(F.col("score") * p.confidence >= THRESHOLD).select(
        *keys,
        F.concat(F.lit(p.name + "#"), F.lower(F.hex(F.xxhash64(F.array_join(ids, " "))))).alias("match_id"),
        "ord",
        "l",
        "t",
        "r",
        "b",
        (F.col("score") * p.confidence).alias("precision"),
        merged(F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]")), static_fields(p.static_data)).alias("content"),
        F.transform("items", lambda x, i: F.struct((i + 1).cast("string").alias("name"), x["match_id"].alias("child"), F.lit(True).alias("inner"))).alias("children"),
    )


def indexed_items(arrays: DataFrame) -> DataFrame:
    """(doc_id, array_id, match_id, index_in_array): the items of arrays, numbered from 1."""
    return arrays.select("doc_id", F.col("match_id").alias("array_id"), F.posexplode("children").alias("i", "c")).select("doc_id", "array_id", F.col("c.child").alias("match_id"), (F.col("i") + 1).alias("index_in_array"))
