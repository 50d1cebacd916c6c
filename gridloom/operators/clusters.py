"""Clusters of one document's boxes: connected groups, and their division by size or count. Plain Python and numpy."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import product

from gridloom.plans.ranges import Span, split_counts

Box = tuple[int, int, int, int]
#: States of a division that are kept beside one another; beyond, the best are.
STATES = 1024


def touch(p: Box, q: Box) -> int:
    return max(0, p[0] - q[2], q[0] - p[2]) + max(0, p[1] - q[3], q[1] - p[3])


def contact(p: Box, q: Box) -> int:
    inside = lambda a, b: b[0] >= a[0] and b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3]
    if inside(p, q) or inside(q, p):
        return 0
    gap, missing = [], []
    for lo, hi in ((0, 2), (1, 3)):
        g = max(0, p[lo] - q[hi], q[lo] - p[hi])
        common = max(0, min(p[hi], q[hi]) - max(p[lo], q[lo]))
        gap.append(g)
        missing.append(min(p[hi] - p[lo], q[hi] - q[lo]) + (g or -common))
    return min(gap[0] + missing[1], gap[1] + missing[0])


DISTANCES = {"corner": touch, "side": contact}


def bounds(boxes: list[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def neighbours(boxes: list[Box], gap: Span, kind: str) -> list[set[int]]:
    """For each box those at a distance in ``gap``. With a bounded gap, only boxes in near buckets are compared."""
    far = DISTANCES[kind]
    out: list[set[int]] = [set() for _ in boxes]
    if gap.stop is None:
        pairs = ((i, j) for i in range(len(boxes)) for j in range(i))
    else:
        size = max(max(b[2] - b[0], b[3] - b[1]) for b in boxes) + max(0, gap.stop) + 1
        held: dict[tuple[int, int], list[int]] = {}
        for i, b in enumerate(boxes):
            held.setdefault((b[0] // size, b[1] // size), []).append(i)
        around = tuple(product((-1, 0, 1), repeat=2))
        pairs = ((i, j) for (x, y), who in held.items() for dx, dy in around for i in who for j in held.get((x + dx, y + dy), ()) if j < i)
    for i, j in pairs:
        if far(boxes[i], boxes[j]) in gap:
            out[i].add(j)
            out[j].add(i)
    return out


def connected(boxes: list[Box], gap: Span, kind: str) -> list[list[int]]:
    """Groups linked by distances in ``gap``, each in order, by their first box."""
    near = neighbours(boxes, gap, kind) if boxes else []
    seen: set[int] = set()
    out = []
    for i in range(len(boxes)):
        if i not in seen:
            todo, part = [i], []
            seen.add(i)
            while todo:
                j = todo.pop()
                part.append(j)
                new = near[j] - seen
                seen |= new
                todo += new
            out.append(sorted(part))
    return out


def fits(boxes: list[Box], who: list[int], count: Span, size: tuple[Span, Span] | None) -> bool:
    """Whether boxes are as many as ``count`` says and their bounds of the wanted size."""
    if len(who) not in count:
        return False
    l, t, r, b = bounds([boxes[i] for i in who])
    return size is None or ((r - l) in size[0] and (b - t) in size[1])


def _windows(edges: list[tuple[int, int]], span: Span) -> Iterator[tuple[int, int]]:
    """From a member's low edge to a member's high edge, all lengths in ``span``."""
    lows, highs = sorted({a for a, _ in edges}), sorted({b for _, b in edges})
    for a in lows:
        i = bisect_left(highs, a + max(1, span.start or 1))
        j = len(highs) if span.stop is None else bisect_right(highs, a + span.stop)
        for b in highs[i:j]:
            yield a, b


def fitting_parts(boxes: list[Box], part: list[int], count: Span, size: tuple[Span, Span], gap: Span, kind: str) -> set[tuple[int, ...]]:
    """Every connected group that all members inside some window of a wanted size form, if it fits."""
    at: dict[tuple[int, int], list[int]] = {}
    for i in part:
        at.setdefault((boxes[i][0], boxes[i][1]), []).append(i)
    lefts, tops = sorted({l for l, _ in at}), sorted({t for _, t in at})
    across = list(_windows([(boxes[i][0], boxes[i][2]) for i in part], size[0]))
    down = list(_windows([(boxes[i][1], boxes[i][3]) for i in part], size[1]))
    out = set()
    for (l, r), (t, b) in product(across, down):
        xs, ys = lefts[bisect_left(lefts, l) : bisect_left(lefts, r)], tops[bisect_left(tops, t) : bisect_left(tops, b)]
        inside = [i for x, y in product(xs, ys) for i in at.get((x, y), ()) if boxes[i][2] <= r and boxes[i][3] <= b]
        if len(inside) >= (count.start or 1):
            for who in connected([boxes[i] for i in inside], gap, kind):
                group = sorted(inside[k] for k in who)
                if fits(boxes, group, count, size):
                    out.add(tuple(group))
    return out


def tiled(boxes: list[Box], part: list[int], count: Span, size: tuple[Span, Span], gap: Span, kind: str, states: int = STATES) -> list[list[int]]:
    """Disjoint fitting parts that leave out the fewest members, of those the fewest parts.

    Members are taken from the top left; each is left out, or begins one of the parts of which it is the
    first. What is known of a choice is which later members it covers, so choices that agree there are
    one state. Up to ``states`` of them are kept, which is exact until there are more; then the best.
    """
    order = sorted(part, key=lambda i: (boxes[i][1], boxes[i][0], i))
    place = {i: k for k, i in enumerate(order)}
    begun: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    most = 1
    for who in sorted(fitting_parts(boxes, part, count, size, gap, kind), key=lambda w: (-len(w), w)):
        mask = sum(1 << place[i] for i in who)
        begun.setdefault((mask & -mask).bit_length() - 1, []).append((mask, who))
        most = max(most, len(who))
    front: dict[int, tuple[int, int, tuple]] = {0: (0, 0, ())}
    for k in range(len(order)):
        now: dict[int, tuple[int, int, tuple]] = {}

        def reach(mask: int, out: int, n: int, chosen: tuple) -> None:
            if mask not in now or (out, n) < now[mask][:2]:
                now[mask] = (out, n, chosen)

        for mask, (out, n, chosen) in front.items():
            if mask >> k & 1:
                reach(mask ^ 1 << k, out, n, chosen)
                continue
            for own, who in begun.get(k, ()):
                if not own & mask:
                    reach((own | mask) ^ 1 << k, out, n + 1, (who, chosen))
            reach(mask, out + 1, n, chosen)
        if len(now) > states:
            # Members that are covered ahead save parts later.
            kept = sorted(now, key=lambda m: (now[m][0], now[m][1] - m.bit_count() / most, m))[:states]
            now = {m: now[m] for m in kept}
        front = now
    found, chosen = [], front[0][2] if front else ()
    while chosen:
        who, chosen = chosen
        found.append(list(who))
    return sorted(found)


def _peel(left: set[int], near: list[set[int]], rank: list[tuple], wanted: int) -> set[int]:
    """A connected part of ``wanted`` members, or as many as can be, without which the rest stays connected.

    The part is a union of whole subtrees of a spanning tree, whose root is the last member, so the tree
    still spans what is left.
    """
    root = max(left, key=rank.__getitem__)
    children: dict[int, set[int]] = {root: set()}
    todo = [root]
    for i in todo:  # breadth first: ``todo`` grows
        for j in sorted(near[i] & left - children.keys(), key=rank.__getitem__, reverse=True):
            children[i].add(j)
            children[j] = set()
            todo.append(j)
    if len(children) <= wanted:
        return set(children)
    best: set[int] = set()
    for leaf in sorted((i for i in children if not children[i]), key=rank.__getitem__):
        took = {leaf}
        while len(took) < wanted:
            rim = [j for i in took for j in near[i] & children.keys() - took if children[j] <= took]
            if not rim:
                break
            took.add(min(rim, key=rank.__getitem__))
        if len(took) > len(best):
            best = took
        if len(best) >= wanted:
            break
    return best


def peeled(boxes: list[Box], part: list[int], count: Span, gap: Span, kind: str) -> list[list[int]]:
    """Connected parts of wanted counts, cut from a cluster one after another from the top left, each so that the rest stays in one piece."""
    near = neighbours([boxes[i] for i in part], gap, kind)
    rank = [(boxes[i][0] + boxes[i][1], boxes[i][1], k) for k, i in enumerate(part)]
    left, out = set(range(len(part))), []
    while wanted := split_counts(len(left), count.start or 1, count.stop):
        took = _peel(left, near, rank, wanted[0])
        if len(took) in count:
            out.append(sorted(part[k] for k in took))
        else:  # no such part has the rest in one piece: one member is left out
            took = _peel(left, near, rank, 1)
        left -= took
    return out


def divided(boxes: list[Box], part: list[int], count: Span, size: tuple[Span, Span] | None, breakdown: bool, gap: Span, kind: str) -> list[list[int]]:
    """A cluster if it fits; if it is too large and may be broken down, parts of it that fit; else nothing."""
    if fits(boxes, part, count, size):
        return [part]
    l, t, r, b = bounds([boxes[i] for i in part])
    small = len(part) < (count.start or 0) or (size is not None and ((r - l) < (size[0].start or 0) or (b - t) < (size[1].start or 0)))
    if small or not breakdown:
        return []
    if size is not None and not ((r - l) in size[0] and (b - t) in size[1]):
        return tiled(boxes, part, count, size, gap, kind)
    return [who for who in peeled(boxes, part, count, gap, kind) if fits(boxes, who, count, size)]
