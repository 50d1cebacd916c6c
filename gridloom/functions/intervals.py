"""Interval and box arithmetic as Spark columns: NULL is an open end.

A span is two columns (start, stop). A ranged segment has ranged ends: columns a0, a1 (its first end) and
b0, b1 (its second). A ranged box is a struct of RANGED fields; a box is a struct of l, t, r, b, where r
and b are exclusive. Built-in functions only, so all stays in generated code.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.plans.ranges import Span

RANGED = ["xa0", "xa1", "xb0", "xb1", "ya0", "ya1", "yb0", "yb1"]
RANGED_TYPE = "struct<" + ",".join(f"{f}:int" for f in RANGED) + ">"


class Pair(NamedTuple):
    """The two ends of a span, as columns."""

    start: Column
    stop: Column


def lit_pair(span: Span) -> Pair:
    return Pair(F.lit(span.start).cast("int"), F.lit(span.stop).cast("int"))


def within(v: Column, span: Span) -> Column:
    """Whether a value lies in a fixed span."""
    tests = ([v >= span.start] if span.start is not None else []) + ([v <= span.stop] if span.stop is not None else [])
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def contains(p: Pair, v: Column) -> Column:
    return (p.start.isNull() | (v >= p.start)) & (p.stop.isNull() | (v <= p.stop))


def includes(p: Pair, q: Pair) -> Column:
    low = p.start.isNull() | F.coalesce(q.start >= p.start, F.lit(False))
    return low & (p.stop.isNull() | F.coalesce(q.stop <= p.stop, F.lit(False)))


def plus(p: Pair, q: Pair) -> Pair:
    return Pair(p.start + q.start, p.stop + q.stop)


def minus(p: Pair, q: Pair) -> Pair:
    return Pair(p.start - q.stop, p.stop - q.start)


def before(p: Pair, q: Pair) -> Column:
    return F.coalesce(p.stop < q.start, F.lit(False))


def intersect(p: Pair, q: Pair) -> Pair:
    """May be empty: test with ``valid``. greatest and least pass over NULL, which is the rule for open ends."""
    return Pair(F.greatest(p.start, q.start), F.least(p.stop, q.stop))


def union(p: Pair, q: Pair) -> Pair:
    open_start, open_stop = p.start.isNull() | q.start.isNull(), p.stop.isNull() | q.stop.isNull()
    return Pair(F.when(~open_start, F.least(p.start, q.start)), F.when(~open_stop, F.greatest(p.stop, q.stop)))


def union_limited(p: Pair, q: Pair) -> Pair:
    return Pair(F.least(p.start, q.start), F.greatest(p.stop, q.stop))


def valid(p: Pair) -> Column:
    return F.coalesce(p.start <= p.stop, F.lit(True))


class Segment(NamedTuple):
    a: Pair
    b: Pair


def segment(rb: Column, axis: str) -> Segment:
    return Segment(Pair(rb[f"{axis}a0"], rb[f"{axis}a1"]), Pair(rb[f"{axis}b0"], rb[f"{axis}b1"]))


def restricted_by_size(s: Segment, size: Span) -> Segment:
    """Ends narrowed so that a length in ``size`` fits between them."""
    z = lit_pair(size)
    return Segment(intersect(s.a, minus(s.b, z)), intersect(s.b, plus(s.a, z)))


def intersect_ends(s: Segment, o: Segment) -> Segment:
    return Segment(intersect(s.a, o.a), intersect(s.b, o.b))


def segment_valid(s: Segment) -> Column:
    return valid(s.a) & valid(s.b) & valid(Pair(s.a.start, s.b.stop))


def ranged_box(x: Segment, y: Segment) -> Column:
    ends = [*x.a, *x.b, *y.a, *y.b]
    return F.struct(*[e.cast("int").alias(f) for e, f in zip(ends, RANGED)])


def ranged_valid(rb: Column) -> Column:
    """Every end a span, each segment's outer range one, and no side of fixed length 0."""
    x, y = segment(rb, "x"), segment(rb, "y")

    def flat(s: Segment) -> Column:
        point = (s.a.start == s.a.stop) & (s.b.start == s.b.stop) & (s.a.start == s.b.start)
        return F.coalesce(point, F.lit(False))

    return segment_valid(x) & segment_valid(y) & ~flat(x) & ~flat(y)


def intersect_borders(p: Column, q: Column, size: tuple[Span, Span] | None = None) -> Column:
    """Both boxes' ends intersected; narrowed by a size where one is given."""
    x = intersect_ends(segment(p, "x"), segment(q, "x"))
    y = intersect_ends(segment(p, "y"), segment(q, "y"))
    if size:
        x, y = restricted_by_size(x, size[0]), restricted_by_size(y, size[1])
    return ranged_box(x, y)


def borders_meet(p: Column, q: Column) -> Column:
    """Whether both boxes' ends meet one by one: what ``intersect_borders`` takes to be valid at least, and far less work."""
    ok = F.lit(True)
    for axis in "yx":
        for one, other in zip(segment(p, axis), segment(q, axis)):
            ok = ok & ~before(one, other) & ~before(other, one)
    return ok


def narrowed(rb: Column, size: tuple[Span, Span]) -> Column:
    return ranged_box(restricted_by_size(segment(rb, "x"), size[0]), restricted_by_size(segment(rb, "y"), size[1]))


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in zip((left, top, right, bottom), "ltrb")])


def minimal_box(rb: Column) -> Column:
    """The definite box between the inner ends; NULL where an end is open or the ends cross."""
    ok = (rb["xa1"] < rb["xb0"]) & (rb["ya1"] < rb["yb0"])
    return F.when(ok, box(rb["xa1"], rb["ya1"], rb["xb0"], rb["yb0"]))


def maximal_box(rb: Column) -> Column:
    return box(rb["xa0"], rb["ya0"], rb["xb1"], rb["yb1"])


def box_in_maximal(b: Column, rb: Column) -> Column:
    """Whether a box lies in the outer ranges of a ranged one."""
    ge = lambda v, low: low.isNull() | (v >= low)
    le = lambda v, high: high.isNull() | (v <= high)
    return ge(b["l"], rb["xa0"]) & le(b["r"], rb["xb1"]) & ge(b["t"], rb["ya0"]) & le(b["b"], rb["yb1"])


def nested(p: Column, q: Column) -> Column:
    """Whether ``q`` lies in ``p``."""
    return (q["l"] >= p["l"]) & (q["t"] >= p["t"]) & (q["r"] <= p["r"]) & (q["b"] <= p["b"])


def overlaps(p: Column, q: Column) -> Column:
    """Whether the boxes share a cell."""
    return (p["l"] < q["r"]) & (q["l"] < p["r"]) & (p["t"] < q["b"]) & (q["t"] < p["b"])


def box_intersect(p: Column, q: Column) -> Column:
    """The shared box; NULL where the boxes don't even touch."""
    o = box(F.greatest(p["l"], q["l"]), F.greatest(p["t"], q["t"]), F.least(p["r"], q["r"]), F.least(p["b"], q["b"]))
    return F.when((o["l"] <= o["r"]) & (o["t"] <= o["b"]), o)


def box_union(p: Column, q: Column) -> Column:
    """The bounding box of both; a NULL box is none."""
    o = box(F.least(p["l"], q["l"]), F.least(p["t"], q["t"]), F.greatest(p["r"], q["r"]), F.greatest(p["b"], q["b"]))
    return F.when(p.isNotNull() | q.isNotNull(), o)


def box_area(p: Column) -> Column:
    return (p["r"] - p["l"]) * (p["b"] - p["t"])


def perimeter(p: Column) -> Column:
    return 2 * ((p["r"] - p["l"]) + (p["b"] - p["t"]))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot((x1 - x2).cast("double"), (y1 - y2).cast("double"))


def point_to_box(x: Column, y: Column, b: Column) -> Column:
    """0 inside, else the steps to the nearest side or corner."""
    outside = lambda v, lo, hi: F.greatest(F.lit(0), lo - v, v - hi)
    return outside(x, b["l"], b["r"]) + outside(y, b["t"], b["b"])


def _gaps(p: Column, q: Column) -> tuple[Column, Column]:
    dx = F.greatest(F.lit(0), p["l"] - q["r"], q["l"] - p["r"])
    return dx, F.greatest(F.lit(0), p["t"] - q["b"], q["t"] - p["b"])


def distance_to_touch(p: Column, q: Column) -> Column:
    """Steps until the boxes touch by a side or a corner; 0 where they touch or overlap."""
    dx, dy = _gaps(p, q)
    return dx + dy


def distance_to_contact(p: Column, q: Column) -> Column:
    """Steps until a whole side of one lies along the other; 0 where one lies in the other."""
    gx, gy = _gaps(p, q)

    def missing(lo: str, hi: str, gap: Column) -> Column:
        side = F.least(p[hi] - p[lo], q[hi] - q[lo])
        common = F.greatest(F.lit(0), F.least(p[hi], q[hi]) - F.greatest(p[lo], q[lo]))
        return side + F.when(gap > 0, gap).otherwise(-common)

    d = F.least(gx + missing("t", "b", gy), gy + missing("l", "r", gx))
    return F.when(nested(p, q) | nested(q, p), F.lit(0)).otherwise(d)


def _corner_steps(p: Column, q: Column) -> list[tuple[Column, Column]]:
    return [(F.abs(p[x] - q[x]), F.abs(p[y] - q[y])) for x, y in (("l", "t"), ("r", "t"), ("r", "b"), ("l", "b"))]


def distance_to_overlap(p: Column, q: Column) -> Column:
    """Steps until two corresponding corners meet; 0 where one box lies in the other."""
    d = F.least(*[dx + dy for dx, dy in _corner_steps(p, q)])
    return F.when(nested(p, q) | nested(q, p), F.lit(0)).otherwise(d)


def distance_by_axis(p: Column, q: Column) -> Column:
    """As a struct (near, total): the smaller axis of the way to overlap and its sum, for the first of the nearest corners."""
    steps = F.array_min(F.array(*[F.struct((dx + dy).alias("total"), F.lit(i).alias("i"), F.least(dx, dy).alias("near")) for i, (dx, dy) in enumerate(_corner_steps(p, q))]))
    inside = nested(p, q) | nested(q, p)
    return F.struct(F.when(inside, F.lit(0)).otherwise(steps["near"]).alias("near"), F.when(inside, F.lit(0)).otherwise(steps["total"]).alias("total"))


def relation(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """The kind of relation of segment 1 to segment 2, by their ends."""
    return (
        F.when((a1 == a2) & (b1 == b2), "equal")
        .when(b1 < a2, "before")
        .when(a1 > b2, "after")
        .when(b1 == a2, "touches_before")
        .when(a1 == b2, "touches_after")
        .when((a1 == a2) & (b1 < b2), "starts")
        .when((a1 == a2) & (b1 > b2), "started_by")
        .when((b1 == b2) & (a1 > a2), "finishes")
        .when((b1 == b2) & (a1 < a2), "finished_by")
        .when((a1 > a2) & (b1 < b2), "inside")
        .when((a1 < a2) & (b1 > b2), "covers")
        .when(a1 < a2, "overlaps_before")
        .otherwise("overlaps_after")
    )


def shared_segment(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """What two segments have in common, as a struct (a, b), a point where they touch; NULL where they are apart."""
    a, b = F.greatest(a1, a2), F.least(b1, b2)
    return F.when(a <= b, F.struct(a.alias("a"), b.alias("b")))
