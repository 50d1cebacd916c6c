"""Area patterns: an n-way spatial join, component by component, of which each anchor keeps its first success.

Every level joins partial matches with the next component's candidates on the document, narrows the
ranged box in which the area may lie, and ranks the candidates of each partial match by distance. The
ranks make a path; the least path of an anchor is what a depth-first search would have found first. An
optional component's absence is one more branch, of the greatest rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.intervals import borders_meet, box_in_maximal, box_union, distance_by_axis, distance_to_overlap, intersect_borders, minimal_box, narrowed, ranged_valid
from gridloom.operators.classify import merged, static_fields
from gridloom.operators.packing import best_choice, clash_sets
from gridloom.plans.constraints import child_region, parent_region
from gridloom.plans.grammar import THRESHOLD, Component, Grammar, Pattern

SKIP = 1 << 30
CUTOFF, LEAST_CUTOFF = 1, 1
#: Areas chosen that the solver holds before it hands them on.
CHOSEN = 10_000


def _size(p: Pattern):
    return (p.size.width, p.size.height) if p.size else None


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in "ltrb"])


def candidates(matches: DataFrame, c: Component, p: Pattern) -> DataFrame:
    """A component's candidates, each with the ranged box where the area may lie."""
    rows = matches.where(F.col("precision") >= c.precision_threshold)
    region = parent_region(_box(), c.location, c.inner)
    if p.size:
        region = narrowed(region, _size(p))
    return rows.select(
        *[k for k in rows.columns if k in ("doc_id", "sid")],
        _box().alias("cbox"),
        region.alias("crb"),
        F.struct(F.lit(c.name).alias("name"), F.col("match_id").alias("child"), F.lit(c.inner).alias("inner"), "content").alias("pick"),
        F.col("precision").alias("cprecision"),
        F.struct(F.col("pord").cast("long").alias("pord"), F.col("ord").cast("long").alias("ord")).alias("corder"),
        F.col("match_id").alias("cid"),
    )


def _related(p: Pattern, done: list[Component], c: Component, at: dict[str, int]) -> Column:
    """Order among similar components, difference among those of one pattern; a skipped one is no bar."""
    ok = F.lit(True)
    here = F.struct(F.col("cbox.l"), F.col("cbox.t"))
    order = [x.name for x in p.components]
    for d in done:
        there = F.col(f"p{at[d.name]}")
        if d.similar(c):
            test = there < here if order.index(d.name) < order.index(c.name) else here < there
        elif d.pattern == c.pattern:
            test = there != here
        else:
            continue
        ok = ok & F.coalesce(test, F.lit(True))
    return ok


def area_matches(grammar: Grammar, p: Pattern, lookup: Callable[[str], DataFrame], dependent: Callable[[str, DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Candidates of an area pattern before overlapping ones are settled.

    ``lookup`` gives a pattern's matches (with pord); ``dependent`` those of a pattern that is searched in
    the region of each partial match, from (doc_id, sid, region); ``keep`` stages partial matches that are
    read twice. An anchor gives one area at most; a
    document in which a required component has no candidate gives none.
    """
    plan = p.planned(grammar)
    at = {c.name: i for i, c in enumerate(plan)}
    top = sum(c.weight for c in p.components if c.weight > 0) or 1.0
    first = plan[0]
    state = candidates(lookup(first.pattern), first, p).where(ranged_valid(F.col("crb"))).select(
        "doc_id",
        F.col("cid").alias("anchor"),
        F.col("corder").alias("aord"),
        F.array().cast("array<int>").alias("path"),
        F.col("crb").alias("rb"),
        (F.col("cbox") if first.inner else F.lit(None).cast("struct<l:int,t:int,r:int,b:int>")).alias("bx"),
        F.array("pick").alias("picks"),
        (F.col("cprecision") * first.weight).alias("score"),
        F.struct(F.col("cbox.l"), F.col("cbox.t")).alias("p0"),
    )
    for i, c in enumerate(plan[1:], 1):
        sub = grammar.patterns[c.pattern]
        keys = ["doc_id"]
        if sub.dependent and dependent:
            state = state.withColumn("sid", F.concat_ws(".", "anchor", F.array_join(F.transform("path", lambda x: x.cast("string")), ".")))
            state = keep(state)
            region = child_region(F.col("rb"), c.location, c.inner)
            if c.size:
                region = narrowed(region, (c.size.width, c.size.height))
            asked = state.select("doc_id", "sid", region.alias("region"))
            cand = candidates(dependent(c.pattern, asked), c, p)
            keys = ["doc_id", "sid"]
        else:
            cand = candidates(lookup(c.pattern), c, p)
        met = intersect_borders(F.col("rb"), F.col("crb"), _size(p))
        on = borders_meet(F.col("rb"), F.col("crb")) & ranged_valid(met) & _related(p, plan[:i], c, at)
        for k in keys:
            cand = cand.withColumnRenamed(k, f"c_{k}")
            on = on & (F.col(k) == F.col(f"c_{k}"))
        joined = state.join(cand, on, "left" if c.optional else "inner").withColumn("nrb", met)
        if c.inner:
            d1, d2 = distance_to_overlap(F.col("cbox"), F.col("bx")), F.lit(0)
        else:
            both = distance_by_axis(F.col("cbox"), F.col("bx"))
            d1, d2 = both["near"], both["total"]
        joined = joined.withColumn("d1", F.coalesce(d1, F.lit(0))).withColumn("d2", F.coalesce(d2, F.lit(0)))
        own = Window.partitionBy("doc_id", "anchor", "path")
        order = own.orderBy("d1", "d2", F.desc("cprecision"), F.col("cbox.l") + F.col("cbox.t"), "corder", "cid")
        ranked = joined.withColumn("rank", F.row_number().over(order)).withColumn("nearest", F.min("d1").over(own))
        ranked = ranked.where(F.col("d1") <= F.greatest(F.col("nearest") * CUTOFF, F.lit(LEAST_CUTOFF)))
        # An optional component's first row stands for its absence too, so the partial matches are read once.
        ways = F.array(F.lit(True), F.lit(False)) if c.optional else F.array(F.lit(True))
        ranked = ranked.withColumn("used", F.explode(F.when(F.col("rank") == 1, ways).otherwise(F.array(F.lit(True)))))
        ranked = ranked.where(~F.col("used") | F.col("cid").isNotNull())
        use = F.col("used")
        grown = ranked.select(
            "doc_id",
            "anchor",
            "aord",
            F.concat("path", F.array(F.when(use, F.col("rank")).otherwise(F.lit(SKIP)))).alias("path"),
            F.when(use, F.col("nrb")).otherwise(F.col("rb")).alias("rb"),
            (F.when(use, box_union(F.col("bx"), F.col("cbox"))).otherwise(F.col("bx")) if c.inner else F.col("bx")).alias("bx"),
            F.when(use, F.concat("picks", F.array("pick"))).otherwise(F.col("picks")).alias("picks"),
            F.when(use, F.col("score") + F.col("cprecision") * c.weight).otherwise(F.col("score")).alias("score"),
            *[f"p{k}" for k in range(i)],
            F.when(use, F.struct(F.col("cbox.l"), F.col("cbox.t"))).alias(f"p{i}"),
        )
        state = grown
    w = Window.partitionBy("doc_id", "anchor").orderBy("path")
    best = state.withColumn("n", F.row_number().over(w)).where("n = 1").withColumn("box", minimal_box(F.col("rb"))).where("box is not null")
    # Places in the order of the anchors; ties fall to their ids, as everywhere.
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("aord", "anchor")))
    precision = F.col("score") / top * p.confidence
    shown = F.filter("picks", lambda x: ~x["name"].startswith("_"))
    body = F.array_join(F.transform(shown, lambda x: F.concat(F.lit('"'), x["name"], F.lit('":'), x["content"])), ",")
    return best.select(
        "doc_id",
        F.concat(F.lit(p.name + "#"), F.lower(F.hex(F.xxhash64(F.array_join(F.transform("picks", lambda x: F.concat_ws("=", x["name"], x["child"])), " "))))).alias("match_id"),
        F.col("place").cast("long").alias("ord"),
        "box.l",
        "box.t",
        "box.r",
        "box.b",
        precision.alias("precision"),
        merged(F.concat(F.lit("{"), body, F.lit("}")), static_fields(p.static_data)).alias("content"),
        F.transform("picks", lambda x: F.struct(x["name"].alias("name"), x["child"].alias("child"), x["inner"].alias("inner"))).alias("children"),
    )


def above_threshold(matches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return matches.where(F.col("precision") >= threshold)


def _ids(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (kind, pa.string()))], ["doc_id", "match_id"])


def settled(matches: DataFrame) -> DataFrame:
    """Of areas that share cells, the arrangement of greatest precision, then of most areas, then farthest to the top left.

    Cells that two areas hold are found by an equi-join on points; only areas in such clashes go to the
    solver, a document at a time.
    """
    points = matches.select("doc_id", "match_id", F.explode(F.sequence("l", F.col("r") - 1)).alias("px"), "t", "b").select("doc_id", "match_id", "px", F.explode(F.sequence("t", F.col("b") - 1)).alias("py"))
    shared = points.groupBy("doc_id", "px", "py").agg(F.collect_set("match_id").alias("who")).where(F.size("who") > 1)
    clashing = shared.select("doc_id", F.explode("who").alias("match_id")).distinct()
    free = matches.join(clashing, ["doc_id", "match_id"], "left_anti")

    def solve(rows: list[tuple]) -> list[int]:
        cells = [[(x, y) for x in range(l, r) for y in range(t, b)] for l, t, r, b, _ in rows]
        return best_choice(clash_sets(len(rows), cells), lambda i: (max(0.0, rows[i][4]), 1, -(rows[i][0] + rows[i][1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows lie document by document; the ids chosen leave by the batch."""
        each = ((batch.schema.field(0).type, row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        kind = None
        for (kind, doc), mine in groupby(each, key=lambda x: (x[0], x[1][0])):
            rows = [row for _, row in mine]
            out += [(doc, rows[i][1]) for i in solve([row[2:] for row in rows])]
            if len(out) >= CHOSEN:
                yield _ids(out, kind)
                out = []
        if out:
            yield _ids(out, kind)

    lined = matches.join(clashing, ["doc_id", "match_id"], "left_semi").repartition("doc_id").sortWithinPartitions("doc_id", "ord", "match_id")
    kept = lined.select("doc_id", "match_id", "l", "t", "r", "b", "precision").mapInArrow(run, f"doc_id {dict(matches.dtypes)['doc_id']}, match_id string")
    return free.unionByName(matches.join(kept, ["doc_id", "match_id"], "left_semi"))


def in_regions(matches: DataFrame, asked: DataFrame) -> DataFrame:
    """Matches inside the regions asked for: (doc_id, sid) with each match, its box within the ranged region."""
    joined = asked.join(matches, "doc_id").where(box_in_maximal(_box(), F.col("region")))
    return joined.drop("region")
