"""Closed integer intervals with open ends, and their notation. These live on the driver and become literals."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

MANY = 999_999_999
_NUMBER = r"[+-]?\d+"


@dataclass(frozen=True)
class Span:
    """``start`` to ``stop``, both included; None is unbounded."""

    start: int | None = None
    stop: int | None = None

    def __post_init__(self) -> None:
        if self.start is not None and self.stop is not None and self.start > self.stop:
            raise ValueError(f"{self.start} is above {self.stop}")

    def __contains__(self, v: float) -> bool:
        return (self.start is None or v >= self.start) and (self.stop is None or v <= self.stop)

    def includes(self, other: Span) -> bool:
        low = self.start is None or (other.start is not None and other.start >= self.start)
        high = self.stop is None or (other.stop is not None and other.stop <= self.stop)
        return low and high

    @classmethod
    def make(cls, value) -> Span:
        """A span from a span, a number, a notation, or a pair of ends."""
        if isinstance(value, Span):
            return value
        return parse_span(value) if isinstance(value, (int, str)) else cls(*value)

    @property
    def is_point(self) -> bool:
        return self.start is not None and self.start == self.stop

    @property
    def is_open(self) -> bool:
        return self.start is None or self.stop is None

    @property
    def point(self) -> int | None:
        return self.start if self.is_point else None

    def __neg__(self) -> Span:
        return Span(None if self.stop is None else -self.stop, None if self.start is None else -self.start)

    def __add__(self, other: Span | int) -> Span:
        o = other if isinstance(other, Span) else Span(other, other)
        add = lambda a, b: None if a is None or b is None else a + b
        return Span(add(self.start, o.start), add(self.stop, o.stop))

    __radd__ = __add__

    def __sub__(self, other: Span | int) -> Span:
        return self + (-other if isinstance(other, Span) else -other)

    def __rsub__(self, other: int) -> Span:
        return -self + other

    def before(self, other: Span) -> bool:
        """Wholly below the other; never where either is unbounded on that side."""
        return self.stop is not None and other.start is not None and self.stop < other.start

    def intersect(self, other: Span) -> Span | None:
        starts = [v for v in (self.start, other.start) if v is not None]
        stops = [v for v in (self.stop, other.stop) if v is not None]
        a, b = max(starts, default=None), min(stops, default=None)
        return None if a is not None and b is not None and a > b else Span(a, b)

    def union(self, other: Span) -> Span:
        a = None if None in (self.start, other.start) else min(self.start, other.start)
        b = None if None in (self.stop, other.stop) else max(self.stop, other.stop)
        return Span(a, b)

    def union_limited(self, other: Span) -> Span | None:
        """The union of what is bounded; None if that is no interval."""
        starts = [v for v in (self.start, other.start) if v is not None]
        stops = [v for v in (self.stop, other.stop) if v is not None]
        a, b = min(starts, default=None), max(stops, default=None)
        return None if a is not None and b is not None and a > b else Span(a, b)

    def strict_union(self, other: Span) -> Span | None:
        return self.union(other) if self.intersect(other) else None

    def trimmed_left(self, v: int) -> Span | None:
        return self.intersect(Span(v, None))

    def trimmed_right(self, v: int) -> Span | None:
        return self.intersect(Span(None, v))

    @property
    def flexibility(self) -> int:
        """How little the interval restricts: its length, or a large number for each open end."""
        opened = (self.start is None) + (self.stop is None)
        return (self.stop - self.start + 1) if not opened else 999 if opened == 1 else 999_999


def flexibility(spans) -> int:
    """The product of the spans' flexibilities, up to MANY."""
    return min(MANY, math.prod(s.flexibility for s in spans))


@lru_cache(maxsize=4096)
def parse_span(s: str | int) -> Span:
    """``3``, ``3+``, ``3-`` (3 or less), ``3..5``, ``3, 5``, ``*`` (any), ``* .. 5``; signs before a number belong to it."""
    if isinstance(s, int):
        return Span(s, s)
    s = s.strip()
    if s == "*":
        return Span()
    if m := re.fullmatch(rf"({_NUMBER})([+-]?)", s):
        v = int(m[1])
        return {"": Span(v, v), "+": Span(v, None), "-": Span(None, v)}[m[2]]
    if m := re.fullmatch(rf"({_NUMBER}|\*)\s*(?:\.{{2,3}}|,)\s*({_NUMBER}|\*)", s):
        return Span(*(None if v == "*" else int(v) for v in m.groups()))
    raise ValueError(f"no range: {s!r}")


def parse_size(s: str) -> tuple[Span, Span]:
    """``4+ x 1..2``: the ranges of width and height; the sign between may be Latin or Cyrillic."""
    m = re.fullmatch(r"(.+?)\s*[xXхХ]\s*(.+)", s.strip())
    if not m:
        raise ValueError(f"no size: {s!r}")
    return parse_span(m[1]), parse_span(m[2])


def split_counts(total: int, least: int, most: int) -> list[int]:
    """The fewest parts of ``least`` to ``most`` each, largest first, whose sum comes nearest to ``total``."""
    if total < least:
        return []
    count = -(-total // most)
    if count * least > total:  # no exact split: as many full parts as fit
        return [most] * (total // most)
    parts, spare = [], count * most - total
    for _ in range(count):
        parts.append(most)
    i = count - 1
    while spare:
        cut = min(spare, most - least)
        parts[i] -= cut
        spare -= cut
        i -= 1
    return sorted(parts, reverse=True)
