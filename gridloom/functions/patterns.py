"""Cell types: regular expressions with confidences, compiled from their declarations to Spark columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import preprocessed

FLAGS = {"I": "i", "IGNORECASE": "i", "M": "m", "MULTILINE": "m", "S": "s", "DOTALL": "s", "X": "x", "VERBOSE": "x"}
#: What the letter helpers stand for in patterns of syntax "+letters".
LETTERS = {"Z": "[A-Z]", "z": "[a-z]", "Я": "[А-ЯЁ]", "я": "[а-яё]", "б": "[a-zа-яё]", "Б": "[A-ZА-ЯЁ]", "L": "[A-ZА-ЯЁa-zа-яё]"}
MATCH_TYPE = "struct<cell_type:string,pattern_ix:int,confidence:double,text:string,matched:string,precision:double,captures:map<string,string>>"


def decode_spaces(pattern: str) -> str:
    """In a spaced pattern three spaces stand for one white-space character, two for some, one for any number."""
    return re.sub(r" {3}| {2}| ", lambda m: {3: r"\s", 2: r"\s+", 1: r"\s*"}[len(m[0])], pattern)


def inject_letters(pattern: str) -> str:
    """Letter helpers for character classes; an escaped backslash before the letter is none."""
    return re.sub(r"(\\\\)|\\([ZzЯяБбL])", lambda m: m[1] or LETTERS[m[2]], pattern)


def java_pattern(pattern: str, flags: str = "") -> str:
    r"""A Python regular expression in Java's dialect: named groups lose their underscores' prefix, \Z is the very end, classes are Unicode's."""
    names: dict[str, str] = {}

    def name(n: str) -> str:
        names.setdefault(n, "g" + re.sub(r"[^A-Za-z0-9]", "", n) + str(len(names)))
        return names[n]

    p = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{name(m[1])}>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{name(m[1])}>", p)
    p = re.sub(r"(\\\\)|\\Z", lambda m: m[1] or r"\z", p)
    p = _escaped_classes(p)
    letters = "".join(dict.fromkeys(FLAGS[f] for f in flags.split() if f in FLAGS))
    return f"(?U{letters}{'u' if 'i' in letters else ''}){p}"


def _escaped_classes(p: str) -> str:
    """Inside [...] Java reads [ and && as operators; Python doesn't. Outside, a repetition needs its lower bound."""
    out, inside, i = [], False, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            out.append(p[i : i + 2])
            i += 2
            continue
        if not inside and c == "{" and p[i + 1 : i + 2] == ",":
            out.append("{0")
        elif not inside and c == "[":
            inside = True
            out.append(c)
            if p[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if p[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        elif inside and c == "]":
            inside = False
            out.append(c)
        elif inside and (c == "[" or (c == "&" and p[i + 1 : i + 2] == "&")):
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


@dataclass
class StringPattern:
    """One alternative of a cell type. See the README for the meaning of each field."""

    pattern: str
    confidence: float = 0.5
    pattern_syntax: str = "re"
    pattern_flags: str = ""
    captures: list[str] = field(default_factory=list)
    preprocess: list[str] = field(default_factory=list)
    anchors: str | list[str] = "start"

    def __post_init__(self) -> None:
        if not self.pattern:
            raise ValueError("a pattern must not be empty")
        if not 0 <= self.confidence <= 1:
            raise ValueError(f"a confidence is between 0 and 1: {self.confidence}")
        if isinstance(self.preprocess, str):
            self.preprocess = re.split(r"[\s,;]+", self.preprocess.strip())
        if isinstance(self.captures, str):
            self.captures = re.split(r"[\s,;]+", self.captures.strip())
        self.preprocess, self.captures = list(self.preprocess or []), list(self.captures or [])
        raw = self.anchors or ""
        self.start = any(k in raw for k in ("start", "^", "both"))
        self.end = any(k in raw for k in ("end", "$", "both"))
        self.regex = None
        if self.pattern_syntax != "plain":
            p = self.pattern
            if "re-spaces" in self.pattern_syntax:
                p = decode_spaces(p)
            if "+letters" in self.pattern_syntax:
                p = inject_letters(p)
            self.regex = p

    @property
    def plain(self) -> bool:
        return self.regex is None

    def java(self) -> str:
        p = java_pattern(self.regex, self.pattern_flags or "")
        head = re.match(r"\(\?\w+\)", p)[0]
        body = f"(?:{p[len(head):]}{chr(10) if 'x' in head else ''})"
        return head + (r"\A" if self.start else "") + body + (r"\z" if self.end else "")

    def groups(self) -> list[tuple[str, int]]:
        """Names and numbers of what is captured: by ``captures``, if named groups don't name the same."""
        compiled = re.compile(self.regex)
        named = compiled.groupindex
        if self.captures and set(named) == set(self.captures):
            return [(n, named[n]) for n in self.captures]
        if self.captures:
            return [(n, i) for i, n in enumerate(self.captures, 1) if i <= compiled.groups]
        return [(str(i), i) for i in range(1, compiled.groups + 1)] + list(named.items())

    def match(self, content: Column, cell_type: str, ix: int) -> Column:
        """A struct of MATCH_TYPE where the content matches, else NULL."""
        text = preprocessed(content, self.preprocess)
        none = F.create_map().cast("map<string,string>")
        if self.plain:
            hit, matched, captures = text == self.pattern, text, none
        else:
            p = self.java()
            hit, matched = text.rlike(p), F.regexp_extract(text, p, 0)
            groups = self.groups()
            captures = F.create_map(*[x for n, i in groups for x in (F.lit(n), F.regexp_extract(text, p, i))]) if groups else none
        share = F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.length(matched) / F.length(text))
        fields = F.struct(
            F.lit(cell_type).alias("cell_type"),
            F.lit(ix).alias("pattern_ix"),
            F.lit(float(self.confidence)).alias("confidence"),
            text.alias("text"),
            matched.alias("matched"),
            (F.lit(float(self.confidence)) * share).alias("precision"),
            captures.alias("captures"),
        )
        return F.when(hit, fields)


@dataclass
class CellType:
    """A named list of alternatives; the one of highest confidence that matches stands for the type."""

    name: str
    patterns: list[StringPattern]
    description: str = ""
    update_content: list[str] = field(default_factory=list)

    def match(self, content: Column) -> Column:
        order = sorted(enumerate(self.patterns), key=lambda x: -x[1].confidence)
        return F.coalesce(*[p.match(content, self.name, i) for i, p in order])

    def updated(self, content: Column) -> Column:
        """The content after recognition: empty for a sure match, preprocessed for a likely one, as the type says."""
        m = self.match(content)
        out = content
        if "replace_with_preprocessed" in self.update_content:
            out = F.when(m["confidence"] >= 0.8, m["text"]).otherwise(out)
        if "clear" in self.update_content:
            out = F.when(m["confidence"] == 1, F.lit("")).otherwise(out)
        return out


def read_cell_types(data: list | dict) -> dict[str, CellType]:
    """Cell types from their YAML list; a later type of the same name takes the earlier one's place."""
    out = {}
    entries = data.items() if isinstance(data, dict) else [next(iter(x.items())) for x in data]
    for name, spec in entries:
        known = StringPattern.__dataclass_fields__
        patterns = [StringPattern(**{k: v for k, v in p.items() if k in known and v is not None}) for p in spec["patterns"]]
        updates = spec.get("update_content") or []
        out[name] = CellType(name, patterns, spec.get("description") or "", [updates] if isinstance(updates, str) else list(updates))
    return out


def classify(content: Column, types: list[CellType], limit: int | None = 5) -> Column:
    """An array of matches, one a type, by precision (the type's place breaks ties), ``limit`` at most."""
    if not types:
        return F.array().cast(f"array<{MATCH_TYPE}>")
    found = F.filter(F.array(*[t.match(content) for t in types]), lambda m: m.isNotNull())
    keyed = F.transform(found, lambda m, i: F.struct((-m["precision"]).alias("p"), i.alias("i"), m.alias("m")))
    before = lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(a["i"] - b["i"])
    best = F.transform(F.array_sort(keyed, before), lambda k: k["m"])
    return F.slice(best, 1, limit) if limit else best
