"""Choice of compatible elements: the best sets of which no two clash. Plain Python for one document's worth."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence
from operator import add

#: States of a search that are kept beside one another; beyond, the best are.
STATES = 50_000


def clash_sets(n: int, components: Sequence[Iterable[Hashable]] | None = None, compatible: Callable[[int, int], bool] | None = None) -> list[set[int]]:
    """For each element those it clashes with: by shared components, or by a test of pairs."""
    out: list[set[int]] = [set() for _ in range(n)]
    if components is not None:
        holders: dict[Hashable, list[int]] = {}
        for i, parts in enumerate(components):
            for p in set(parts):
                holders.setdefault(p, []).append(i)
        for who in holders.values():
            for i in who:
                out[i].update(who)
        for i in range(n):
            out[i].discard(i)
    else:
        for i in range(n):
            for j in range(i):
                if not compatible(i, j):
                    out[i].add(j)
                    out[j].add(i)
    return out


def groups(clashes: list[set[int]]) -> list[list[int]]:
    """Elements that clash with one another, directly or through others."""
    seen: set[int] = set()
    out = []
    for i in range(len(clashes)):
        if i not in seen:
            todo, part = [i], []
            seen.add(i)
            while todo:
                j = todo.pop()
                part.append(j)
                todo += [k for k in clashes[j] if k not in seen]
                seen |= clashes[j]
            out.append(sorted(part))
    return out


def _along(part: list[int], clashes: list[set[int]]) -> list[int]:
    """A group's elements, neighbours near one another: breadth first from one with few clashes."""
    first = min(part, key=lambda i: (len(clashes[i]), i))
    order, seen = [first], {first}
    for i in order:  # grows
        new = sorted(clashes[i] - seen, key=lambda j: (len(clashes[j]), j))
        seen.update(new)
        order += new
    return order


def best_choice(clashes: list[set[int]], value: Callable[[int], tuple], states: int = STATES) -> list[int]:
    """Elements without clashes whose values, added up part by part, are greatest; the first found wins ties.

    Each group that clashes is gone through element by element. All that matters of a choice is which of
    the elements to come it blocks, so choices that block the same are one state, of which the best stays.
    That is exact as long as there are no more than ``states`` of them, whatever the group's size; of more,
    the best are kept. Values count to 12 places.
    """
    out: list[int] = []
    for part in groups(clashes):
        if len(part) == 1:
            out += part
            continue
        order = _along(part, clashes)
        place = {e: k for k, e in enumerate(order)}
        worth = [tuple(round(v * 10**12) for v in value(e)) for e in order]
        front: dict[int, tuple[tuple, tuple]] = {0: ((0,) * len(worth[0]), ())}
        for k, e in enumerate(order):
            later = sum(1 << place[j] for j in clashes[e] if place[j] > k)
            now: dict[int, tuple[tuple, tuple]] = {}
            for mask, (total, chosen) in front.items():
                free = not mask >> k & 1
                rest = mask & ~(1 << k)
                ways = [(rest | later, tuple(map(add, total, worth[k])), (e, chosen))] if free else []
                for m, v, c in [*ways, (rest, total, chosen)]:
                    if m not in now or v > now[m][0]:
                        now[m] = (v, c)
            if len(now) > states:
                kept = sorted(now, key=lambda m: (now[m][0], -m.bit_count()), reverse=True)[:states]
                now = {m: now[m] for m in kept}
            front = now
        chosen = max(front.values(), key=lambda x: x[0])[1]
        while chosen:
            e, chosen = chosen
            out.append(e)
    return sorted(out)


def compatible_combinations(clashes: list[set[int]], most: int | None = None, limit: int | None = None) -> list[list[int]]:
    """All largest possible sets without clashes (none can be added), longest first; of ``most`` elements at most. With ``limit`` the first found only, so many."""
    out: list[list[int]] = []
    everyone = set(range(len(clashes)))

    def grow(chosen: list[int], open_: set[int], done: set[int]) -> None:
        if limit is not None and len(out) >= limit:
            return
        if most is not None and len(chosen) == most:
            out.append(sorted(chosen))
            return
        if not open_ and not done:
            out.append(sorted(chosen))
            return
        pivot = max(open_ | done, key=lambda i: len(open_ - clashes[i] - {i}), default=None)
        skip = open_ - clashes[pivot] - {pivot} if pivot is not None else set()
        for i in sorted(open_ - skip):
            near = everyone - clashes[i] - {i}
            grow([*chosen, i], open_ & near, done & near)
            open_ = open_ - {i}
            done = done | {i}

    grow([], everyone, set())
    unique = {tuple(c): c for c in out}
    return sorted(unique.values(), key=lambda c: (-len(c), c))
