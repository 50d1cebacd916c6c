"""Algebra of ranged segments and boxes, boxes known in part, and relations of segments put into words.

Ends are columns and NULL is an open end, as in ``intervals``. An operation that may have no result gives
a column with it that says whether there is one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.intervals import Pair, Segment, box, includes, intersect, ranged_box, segment, union, union_limited, valid

#: What each kind of relation is called along a row, and how the words change along a column.
RELATIONS = {
    "equal": "совпадает с",
    "before": "на удалении слева от",
    "after": "на удалении справа от",
    "touches_before": "примыкает слева к",
    "touches_after": "примыкает справа к",
    "starts": "включается, примыкая слева, в",
    "started_by": "включает примыкающее слева",
    "finishes": "включается, примыкая справа, в",
    "finished_by": "включает примыкающее справа",
    "inside": "входит в",
    "covers": "включает",
    "overlaps_before": "пересекается с",
    "overlaps_after": "пересекается с",
}
UPRIGHT = {"слева": "сверху", "справа": "снизу"}


class Maybe(NamedTuple):
    """A segment, and whether there is one."""

    segment: Segment
    ok: Column


def repaired(s: Segment) -> Maybe:
    """Half-open inner ends closed by one another where the end ranges meet; none if the first begins after the second ends."""
    meets = valid(intersect(s.a, s.b))
    open_a, open_b = s.a.start.isNull() & s.a.stop.isNull(), s.b.start.isNull() & s.b.stop.isNull()
    fix = meets & ~open_a & ~open_b
    low = F.when(fix & s.b.start.isNull(), s.a.stop).otherwise(s.b.start)
    high = F.when(fix & s.a.stop.isNull(), s.b.start).otherwise(s.a.stop)
    return Maybe(Segment(Pair(s.a.start, high), Pair(low, s.b.stop)), valid(maximal(s)))


def materialised(s: Segment) -> Segment:
    """Open inner ends set to the outer end of their range, where that is known."""
    return Segment(Pair(s.a.start, F.coalesce(s.a.stop, s.a.start)), Pair(F.coalesce(s.b.start, s.b.stop), s.b.stop))


def maximal(s: Segment) -> Pair:
    return Pair(s.a.start, s.b.stop)


def definite(s: Segment) -> tuple[Pair, Column]:
    """What surely belongs to a segment, within its outer ends, and whether there is any."""
    inner = intersect(Pair(s.a.stop, s.b.start), maximal(s))
    return inner, valid(Pair(s.a.stop, s.b.start)) & valid(inner)


def _around(inner: Pair, outer: Pair) -> Segment:
    return Segment(Pair(outer.start, inner.start), Pair(inner.stop, outer.stop))


def combined(s: Segment, o: Segment) -> Maybe:
    """The better defined segment of two: definite parts grow together, within what is possible for both.

    None where the possible parts are apart, or neither has a definite one, or that lies outside them.
    """
    (p, has_p), (q, has_q) = definite(s), definite(o)
    only = lambda has, r: Pair(F.when(has, r.start), F.when(has, r.stop))
    sure = union_limited(only(has_p, p), only(has_q, q))
    outer = intersect(maximal(s), maximal(o))
    inner = intersect(sure, outer)
    return Maybe(_around(inner, outer), (has_p | has_q) & valid(sure) & valid(outer) & valid(inner))


def united(s: Segment, o: Segment) -> Segment:
    """The least segment over both, definite and possible parts each; open inner ends are set first."""
    s, o = materialised(s), materialised(o)
    outer = union(maximal(s), maximal(o))
    return _around(intersect(union(Pair(s.a.stop, s.b.start), Pair(o.a.stop, o.b.start)), outer), outer)


def united_ends(s: Segment, o: Segment) -> Maybe:
    """Each end's ranges united; none where those of one end don't meet."""
    return Maybe(Segment(union(s.a, o.a), union(s.b, o.b)), valid(intersect(s.a, o.a)) & valid(intersect(s.b, o.b)))


def covers(s: Segment, o: Segment) -> Column:
    """Whether each end of the other lies in the range of the same end."""
    return includes(s.a, o.a) & includes(s.b, o.b)


def holds(s: Segment, o: Segment) -> Column:
    """Whether both ends of the other lie in what is possible for this one."""
    return includes(maximal(s), o.a) & includes(maximal(s), o.b)


def combined_boxes(p: Column, q: Column) -> Column:
    """Two ranged boxes combined by axis; NULL where an axis has no combination."""
    x, y = (combined(segment(p, axis), segment(q, axis)) for axis in "xy")
    return F.when(x.ok & y.ok, ranged_box(x.segment, y.segment))


def united_boxes(p: Column, q: Column) -> Column:
    return ranged_box(*(united(segment(p, axis), segment(q, axis)) for axis in "xy"))


def box_between(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box of two points at the ends of either diagonal."""
    return box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


class Side(NamedTuple):
    """One axis of a box known in part, and whether what is known agrees."""

    start: Column
    size: Column
    stop: Column
    ok: Column


def deduced(start: Column, size: Column, stop: Column) -> Side:
    """The missing one of start, size and stop from the other two; not ``ok`` where they contradict or the size is below 0."""
    a, n, b = F.coalesce(start, stop - size), F.coalesce(size, stop - start), F.coalesce(stop, start + size)
    return Side(a, n, b, F.coalesce((n >= 0) & ((a + n == b) | a.isNull()), F.lit(True)))


def offsets(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """How far segment 2's ends lie inside segment 1 (below 0: outside), and the gaps between the segments (below 0: none)."""
    left, right = a1 - b2, a2 - b1
    return F.struct((a2 - a1).alias("inner_left"), (b1 - b2).alias("inner_right"), left.alias("outer_left"), right.alias("outer_right"), F.greatest(left, right).alias("outer"))


def described(kind: Column, first: Column, second: Column, vertical: bool = False) -> Column:
    """A relation's kind in words, between the names of its two segments."""
    words = {k: " ".join(UPRIGHT.get(w.strip(","), w.strip(",")) + "," * w.endswith(",") for w in v.split()) if vertical else v for k, v in RELATIONS.items()}
    return F.concat_ws(" ", first, F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[kind], second)
