"""Where a component lies in its parent, how large it may be, and algebraic conditions, compiled to columns."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.intervals import Pair, Segment, lit_pair, minus, plus, ranged_box, within
from gridloom.plans.ranges import Span, flexibility, parse_size, parse_span

SIDES = ("left", "top", "right", "bottom")
OPPOSITE = {"left": "right", "right": "left", "top": "bottom", "bottom": "top"}
EDGE = {"left": "l", "top": "t", "right": "r", "bottom": "b"}
#: The way in which a coordinate grows towards each side.
SIGN = {"left": -1, "top": -1, "right": 1, "bottom": 1}
RAY = Span(0, None)


@dataclass(frozen=True)
class Size:
    width: Span
    height: Span

    @classmethod
    def parse(cls, data: str) -> Size:
        return cls(*parse_size(data))

    def holds(self, b: Column) -> Column:
        return within(b["r"] - b["l"], self.width) & within(b["b"] - b["t"], self.height)

    @property
    def flexibility(self) -> int:
        return flexibility([self.width, self.height])


def _side_and_role(key: str) -> tuple[str, str | None]:
    """``left``, ``padding-left``, ``margin_top`` and the like."""
    words = re.split(r"[\s_-]+", key.strip().lower())
    role = next((w for w in words if w in ("padding", "margin")), None)
    side = next((w for w in words if w in SIDES), None)
    if side is None:
        raise ValueError(f"no side: {key!r}")
    return side, role


@dataclass
class Location:
    """Gaps between a component's sides and its parent's: paddings to the same side, margins beyond it."""

    padding: dict[str, Span] = field(default_factory=dict)
    margin: dict[str, Span] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: str | dict | list, inner: bool) -> Location:
        """Sides in a string have a gap of 0 inside and 0+ outside; in a list 0; in a dict the gap given."""
        if isinstance(data, str):
            gaps: dict = {s: "0" if inner else "0+" for s in re.split(r"[\s,;]+", data.strip()) if s}
        elif isinstance(data, dict):
            gaps = dict(data)
        else:
            gaps = {}
            for item in data:
                gaps |= {item: "0"} if isinstance(item, str) else dict([item]) if isinstance(item, list) else item
        out = cls()
        for key, gap in gaps.items():
            side, role = _side_and_role(key)
            inside = role == "padding" if role else inner
            span = gap if isinstance(gap, Span) else parse_span(gap) if gap is not None else RAY if inside else Span()
            (out.padding if inside else out.margin)[side] = span
        if inner:
            for side in SIDES:
                out.padding.setdefault(side, RAY)
        elif len(out.margin) == 1 and not out.padding:
            side, gap = next(iter(out.margin.items()))
            if not gap.intersect(Span(None, -1)):
                # One side outside: the component must reach over the parent across that side.
                for s in ("top", "bottom") if side in ("left", "right") else ("left", "right"):
                    out.margin[s] = Span(None, -1)
        return out

    @property
    def flexibility(self) -> int:
        return flexibility([*self.padding.values(), *self.margin.values()])

    def holds(self, parent: Column, child: Column) -> Column:
        """Whether a child's box lies so in its parent's."""
        out = F.lit(True)
        for side, span in self.padding.items():
            out = out & within((parent[EDGE[side]] - child[EDGE[side]]) * SIGN[side], span)
        for side, span in self.margin.items():
            out = out & within((child[EDGE[OPPOSITE[side]]] - parent[EDGE[side]]) * SIGN[side], span)
        return out


def _fixed(v: Column) -> Pair:
    return Pair(v, v)


def parent_region(child: Column, location: Location | None, inner: bool) -> Column:
    """The ranged box in which the parent of a child at a known box may lie."""
    ends: dict[str, Pair] = {}
    any_ = Pair(F.lit(None).cast("int"), F.lit(None).cast("int"))
    for side in SIDES:
        v = _fixed(child[EDGE[side]])
        ends[side] = (minus if SIGN[side] < 0 else plus)(v, lit_pair(RAY)) if inner else any_
    for side, gap in location.padding.items() if location else ():
        v = _fixed(child[EDGE[side]])
        ends[side] = (minus if SIGN[side] < 0 else plus)(v, lit_pair(gap))
    for side, gap in location.margin.items() if location else ():
        v = _fixed(child[EDGE[OPPOSITE[side]]])
        ends[side] = (plus if SIGN[side] < 0 else minus)(v, lit_pair(gap))
    return ranged_box(Segment(ends["left"], ends["right"]), Segment(ends["top"], ends["bottom"]))


def child_region(parent: Column, location: Location | None, inner: bool) -> Column:
    """The ranged box in which a child of a parent at a ranged box may lie."""
    of = {"left": Pair(parent["xa0"], parent["xa1"]), "right": Pair(parent["xb0"], parent["xb1"]), "top": Pair(parent["ya0"], parent["ya1"]), "bottom": Pair(parent["yb0"], parent["yb1"])}
    any_ = Pair(F.lit(None).cast("int"), F.lit(None).cast("int"))
    ends = {s: (plus if SIGN[s] < 0 else minus)(of[s], lit_pair(RAY)) if inner else any_ for s in SIDES}
    for side, gap in location.padding.items() if location else ():
        ends[side] = (plus if SIGN[side] < 0 else minus)(of[side], lit_pair(gap))
    for side, gap in location.margin.items() if location else ():
        ends[OPPOSITE[side]] = (minus if SIGN[side] < 0 else plus)(of[side], lit_pair(gap))
    return ranged_box(Segment(ends["left"], ends["right"]), Segment(ends["top"], ends["bottom"]))


# Algebraic conditions: Python syntax over variables such as this_left, parent_w or name_bottom.

#: Accepted spellings of a box's attributes.
ATTRIBUTES = {"l": "l", "left": "l", "x": "l", "t": "t", "top": "t", "y": "t", "r": "r", "right": "r", "b": "b", "bottom": "b", "w": "w", "width": "w", "h": "h", "height": "h", "sx": "w", "sy": "h"}


def variable(name: str) -> tuple[str, str]:
    """Component and attribute of a variable; without a component it is ``this``."""
    head, _, tail = name.rpartition("_")
    if tail not in ATTRIBUTES:
        raise ValueError(f"no attribute of a box: {name!r}")
    return head or "this", ATTRIBUTES[tail]


class Algebra:
    """A boolean or arithmetic expression: + - * / //, chained comparisons, and/or/not, abs, min, max, conditional."""

    _BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.FloorDiv: lambda a, b: F.floor(a / b), ast.Mod: lambda a, b: F.pmod(a, b)}
    _COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}

    def __init__(self, text: str) -> None:
        self.tree = ast.parse(" ".join(text.split()), mode="eval").body

    @property
    def variables(self) -> list[str]:
        calls = {id(n.func) for n in ast.walk(self.tree) if isinstance(n, ast.Call)}
        return list(dict.fromkeys(n.id for n in ast.walk(self.tree) if isinstance(n, ast.Name) and id(n) not in calls))

    def replaced(self, names: dict[str, str | int]) -> Algebra:
        """With variables given other names or values."""

        class Swap(ast.NodeTransformer):
            def visit_Name(self, node: ast.Name) -> ast.AST:
                if node.id not in names:
                    return node
                v = names[node.id]
                return ast.Constant(v) if isinstance(v, int) else ast.Name(v, ast.Load())

        return Algebra(ast.unparse(Swap().visit(ast.parse(ast.unparse(self.tree), mode="eval")).body))

    def assigned(self) -> dict[str, str]:
        """Variables that an equality of the top conjunction binds, with the other side's text."""
        parts = self.tree.values if isinstance(self.tree, ast.BoolOp) and isinstance(self.tree.op, ast.And) else [self.tree]
        return {p.left.id: ast.unparse(p.comparators[0]) for p in parts if isinstance(p, ast.Compare) and len(p.ops) == 1 and isinstance(p.ops[0], ast.Eq) and isinstance(p.left, ast.Name)}

    def joined(self, other: Algebra, how: str) -> Algebra:
        """and, or or xor of two conditions."""
        a, b = ast.unparse(self.tree), ast.unparse(other.tree)
        return Algebra(f"(({a}) and not ({b})) or (not ({a}) and ({b}))" if how == "xor" else f"({a}) {how} ({b})")

    def negated(self) -> Algebra:
        return Algebra(f"not ({ast.unparse(self.tree)})")

    def column(self, bind: Callable[[str], Column]) -> Column:
        """The expression over columns that ``bind`` finds for its variables; an unknown one raises."""

        def walk(n: ast.AST) -> Column:
            if isinstance(n, ast.Constant):
                return F.lit(n.value)
            if isinstance(n, ast.Name):
                return bind(n.id)
            if isinstance(n, ast.BinOp):
                return self._BINARY[type(n.op)](walk(n.left), walk(n.right))
            if isinstance(n, ast.UnaryOp):
                v = walk(n.operand)
                return ~v if isinstance(n.op, ast.Not) else -v if isinstance(n.op, ast.USub) else v
            if isinstance(n, ast.BoolOp):
                parts = [walk(v) for v in n.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(n.op, ast.And) else out | p
                return out
            if isinstance(n, ast.Compare):
                sides = [walk(v) for v in (n.left, *n.comparators)]
                out = F.lit(True)
                for op, a, b in zip(n.ops, sides, sides[1:]):
                    out = out & self._COMPARE[type(op)](a, b)
                return out
            if isinstance(n, ast.IfExp):
                return F.when(walk(n.test), walk(n.body)).otherwise(walk(n.orelse))
            if isinstance(n, ast.Call):
                args = [walk(a) for a in n.args]
                return {"abs": F.abs, "min": F.least, "max": F.greatest}[n.func.id](*args)
            raise ValueError(f"not supported: {ast.unparse(n)}")

        return walk(self.tree)

    def over_boxes(self, boxes: dict[str, Column]) -> Column:
        """Over boxes by component name; w and h follow from the sides."""

        def bind(name: str) -> Column:
            component, attribute = variable(name)
            if component not in boxes:
                raise KeyError(f"no box for {name!r}")
            b = boxes[component]
            return b["r"] - b["l"] if attribute == "w" else b["b"] - b["t"] if attribute == "h" else b[attribute]

        return self.column(bind)


def box_is_sound(name: str = "this") -> Algebra:
    """What holds for any box."""
    p = f"{name}_"
    return Algebra(f"{p}l + {p}w == {p}r and {p}t + {p}h == {p}b and {p}l < {p}r and {p}t < {p}b")


def inside_container(name: str = "this", outer: str = "parent") -> Algebra:
    """What holds for a box in another."""
    return Algebra(f"{outer}_l <= {name}_l and {outer}_t <= {name}_t and {name}_r <= {outer}_r and {name}_b <= {outer}_b")


def relation_test(text: str) -> Callable[[Column, Column], Column]:
    """A relation between two numbers: ``=``, ``<``, ``<<`` (more than 1 apart), ``<3..5<`` (right minus left in a range), ``<2>`` (distance in one)."""
    s = text.strip()
    if s in ("=", "=="):
        return lambda a, b: a == b
    if s == "<":
        return lambda a, b: a < b
    if s == "<<":
        return lambda a, b: b - a > 1
    if m := re.fullmatch(r"<\s*(.+?)\s*([<>])", s):
        span = parse_span(m[1])
        return lambda a, b: within((b - a) if m[2] == "<" else F.abs(b - a), span)
    raise ValueError(f"no relation: {text!r}")
