"""Grammars: patterns and cell types from YAML, their order of matching, and what extends what."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from gridloom.functions.patterns import CellType, read_cell_types
from gridloom.plans.constraints import Location, Size
from gridloom.plans.ranges import MANY, Span, parse_span

log = logging.getLogger(__name__)
THRESHOLD = 0.3
METRICS = ("area", "width", "height", "precision")


@dataclass
class Overlap:
    """How matches of a pattern that lie over one another are settled: mode, and criteria as (metric, sign)."""

    mode: str = "none"
    criteria: list[tuple[str, int]] = field(default_factory=list)
    unknown: str | None = None

    @classmethod
    def parse(cls, data: dict | None) -> Overlap:
        """No section means no resolution; a section means ``full`` unless it says otherwise."""
        if data is None:
            return cls()
        mode, unknown = data.get("mode", "full"), None
        if mode not in ("none", "full", "partial"):
            log.warning("overlap mode %r is not known; full is used", mode)
            mode, unknown = "full", str(mode)
        raw = data.get("resolution", ["area-max", "precision-max"])
        criteria = []
        for item in raw if isinstance(raw, list) else ["area-max", "precision-max"]:
            metric, _, order = str(item).lower().partition("-")
            if metric in METRICS and order in ("max", "min"):
                criteria.append((metric, 1 if order == "max" else -1))
            else:
                log.warning("overlap criterion %r is not known", item)
        return cls(mode, criteria, unknown) if criteria else cls()


@dataclass
class Component:
    name: str
    pattern: str
    inner: bool
    location: Location | None = None
    size: Size | None = None
    optional: bool = False
    weight: float = 1.0
    precision_threshold: float = THRESHOLD

    @property
    def flexibility(self) -> int:
        """A component without constraints counts as 1, so it comes before merely loose ones."""
        return min(MANY, math.prod(c.flexibility for c in (self.location, self.size) if c))

    def similar(self, other: Component) -> bool:
        """The same role, pattern and constraints: such components are told apart by their order alone."""
        return (self.inner, self.pattern, self.location, self.size) == (other.inner, other.pattern, other.location, other.size)


@dataclass
class Pattern:
    name: str
    kind: str
    description: str = ""
    root: bool = False
    extends: list[str] = field(default_factory=list)
    count_in_document: Span = Span()
    confidence: float = 1.0
    size: Size | None = None
    static_data: dict = field(default_factory=dict)
    overlap: Overlap = field(default_factory=Overlap)
    content_type: str | None = None
    components: list[Component] = field(default_factory=list)
    allows_overlapping: bool = False
    item_pattern: str | None = None
    item_count: Span = Span(1, None)
    direction: str = "auto"
    gap: Span = Span(0, 0)
    distance_kind: str = "corner"
    allow_breakdown: bool = False
    index_items: bool = False

    @property
    def dependent(self) -> bool:
        """Matched only inside an area, in the region its other components leave."""
        return self.kind == "array-in-context"

    def needs(self) -> set[str]:
        return {c.pattern for c in self.components} | ({self.item_pattern} if self.item_pattern else set())

    def planned(self, grammar: Grammar) -> list[Component]:
        """Components in the order of search: required, independent and inner ones first, then the least flexible."""
        return sorted(self.components, key=lambda c: (c.optional, grammar.patterns[c.pattern].dependent, not c.inner, c.flexibility))


KINDS = {"cell", "general", "area", "array", "array-in-context"}


class Grammar:
    """Patterns by name, cell types by name, and the root."""

    def __init__(self, patterns: list[Pattern], cell_types: dict[str, CellType]) -> None:
        self.patterns = {p.name: p for p in patterns}
        self.cell_types = cell_types
        self.root = next((p.name for p in self.patterns.values() if p.root), None)
        for p in self.patterns.values():
            for other in p.needs() | set(p.extends):
                if other not in self.patterns:
                    raise ValueError(f"pattern {p.name!r} refers to {other!r}, which is not defined")

    def bases(self, name: str) -> list[str]:
        """All patterns that a pattern extends, near ones first."""
        out: list[str] = []
        todo = list(self.patterns[name].extends)
        while todo:
            b = todo.pop(0)
            if b == name:
                log.warning("pattern %r extends itself", name)
            elif b not in out:
                out.append(b)
                todo += self.patterns[b].extends
        return out

    def extensions(self, name: str) -> list[str]:
        """All patterns that extend a pattern, in the order of definition."""
        return [p for p in self.patterns if name in self.bases(p)]

    def can_extend(self, name: str, base: str) -> bool:
        return name == base or base in self.bases(name)

    def effective_cell_types(self) -> list[CellType]:
        """Only the types that a cell pattern names."""
        used = {p.content_type for p in self.patterns.values() if p.kind == "cell"}
        return [t for n, t in self.cell_types.items() if n in used]

    def waves(self) -> list[list[str]]:
        """Layers of patterns, each needing earlier layers only; a cycle raises."""
        needs = {n: p.needs() | set(self.extensions(n)) for n, p in self.patterns.items()}
        done: set[str] = set()
        out = []
        while len(done) < len(needs):
            layer = [n for n in needs if n not in done and needs[n] <= done]
            if not layer:
                raise ValueError(f"patterns need one another: {sorted(set(needs) - done)}")
            out.append(layer)
            done |= set(layer)
        return out

    def live(self, target: str | None = None) -> set[str]:
        """The patterns that the target (the root, if none is named) is made of."""
        todo, out = [target or self.root], set()
        while todo:
            n = todo.pop()
            if n and n not in out:
                out.add(n)
                todo += [*self.patterns[n].needs(), *self.extensions(n)]
        return out or set(self.patterns)


def _component(name: str, data: dict, inner: bool, owner: str, made: list[Pattern]) -> Component:
    pattern = data.get("pattern")
    if pattern is None:
        if "pattern_definition" not in data:
            raise ValueError(f"component {name!r} of {owner!r} has no pattern")
        pattern = f"{owner}.{name}[inline]"
        read_pattern(pattern, data["pattern_definition"], made)
    return Component(
        name,
        pattern,
        inner,
        Location.parse(data["location"], inner) if data.get("location") is not None else None,
        Size.parse(data["size"]) if data.get("size") else None,
        bool(data.get("optional", False)),
        float(data.get("weight", 1)),
        float(data.get("precision_threshold", THRESHOLD)),
    )


def read_pattern(name: str, data: dict, made: list[Pattern]) -> None:
    """Adds the pattern, and those defined inside it, to ``made``; an unknown kind is left out."""
    if data.get("kind") not in KINDS:
        log.warning("pattern %r has unknown kind %r", name, data.get("kind"))
        return
    p = Pattern(name, data["kind"])
    for key in ("description", "root", "confidence", "content_type", "item_pattern", "direction", "distance_kind", "allow_breakdown", "index_items", "allows_overlapping"):
        if data.get(key) is not None:
            setattr(p, key, data[key])
    p.extends = [data["extends"]] if isinstance(data.get("extends"), str) else list(data.get("extends") or [])
    p.static_data = dict(data.get("static_data") or {})
    p.overlap = Overlap.parse(data.get("overlap"))
    for key in ("count_in_document", "item_count", "gap"):
        if data.get(key) is not None:
            setattr(p, key, parse_span(data[key]))
    if data.get("size"):
        p.size = Size.parse(data["size"])
    for role in ("inner", "outer"):
        for n, c in (data.get(role) or {}).items():
            p.components.append(_component(n, c or {}, role == "inner", name, made))
    made.append(p)


def find_file(relative: str, *folders: str | Path, steps: int = 5) -> Path:
    """A file below one of the folders, or below one of the ``steps`` folders above it."""
    for folder in folders or (".",):
        at = Path(folder).resolve()
        for _ in range(steps + 1):
            if (at / relative).is_file():
                return at / relative
            at = at.parent
    raise FileNotFoundError(relative)


def read_grammar(source: str | Path | dict, folder: str | Path = ".") -> Grammar:
    """A grammar from a YAML file or its parsed data. Included grammars come first; later definitions replace earlier ones."""
    types: dict[str, CellType] = {}
    made: list[Pattern] = []
    seen: set[Path] = set()

    def load(data: dict, base: Path) -> None:
        for name in data.get("include_grammars") or []:
            path = find_file(name, base)
            if path not in seen:
                seen.add(path)
                load(yaml.safe_load(path.read_text("utf-8")), path.parent)
        if data.get("cell_types_filepath"):
            path = find_file(data["cell_types_filepath"], base)
            types.update(read_cell_types(yaml.safe_load(path.read_text("utf-8"))["cell_types"]))
        if data.get("cell_types"):
            types.update(read_cell_types(data["cell_types"]))
        for name, spec in (data.get("patterns") or {}).items():
            read_pattern(name, spec or {}, made)

    if isinstance(source, dict):
        load(source, Path(folder))
    else:
        path = Path(source)
        seen.add(path.resolve())
        load(yaml.safe_load(path.read_text("utf-8")), path.parent)
    return Grammar(made, types)
