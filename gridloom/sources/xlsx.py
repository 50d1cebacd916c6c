"""Spreadsheets (.xlsx) as grids, read from their XML with the standard library."""

from __future__ import annotations

import colorsys
import io
import itertools
import pickle
import posixpath
import re
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "doc_id string, cell_id long, x int, y int, w int, h int, content string, style struct<font_style:array<string>,background_color:string,borders:array<string>,font_color:string>, error string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: The theme's colours in the order that cells number them, and the sides of a border.
THEME = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6")
SIDES = ("left", "right", "top", "bottom")
SCALE = 240
#: Cells that are held, in a sheet as it is read and in a batch; those before them wait in a file.
BLOCK = 10_000
#: What a file that can't be read may raise.
UNREADABLE = (zipfile.BadZipFile, KeyError, IndexError, ValueError, TypeError, AttributeError, ElementTree.ParseError)
#: The format's numbered colours; the first eight stand twice, and the last two are the system's text and ground.
NUMBERED = """
000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF
800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF
000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99
3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333
000000 FFFFFF
""".split()


def tinted(rgb: str, tint: float) -> str:
    """A colour made darker (tint below 0) or lighter, in steps of hue, lightness and saturation of 1/240."""
    r, g, b = (int(rgb[i : i + 2], 16) / 255 for i in (0, 2, 4))
    h, l, s = (round(v * SCALE) for v in colorsys.rgb_to_hls(r, g, b))
    l = round(l * (1 + tint)) if tint < 0 else round(l * (1 - tint) + (SCALE - SCALE * (1 - tint)))
    return "".join(f"{round(v * 255):02X}" for v in colorsys.hls_to_rgb(h / SCALE, l / SCALE, s / SCALE))


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _place(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", ref)
    return _number(m[1]) - 1, int(m[2]) - 1


class _Reader:
    """Reads XML as it comes: the texts of what ``begin`` asks for, without a tree of the whole."""

    def __init__(self) -> None:
        self.held: list[str] | None = None

    def data(self, s: str) -> None:
        if self.held is not None:
            self.held.append(s)


class _Strings(_Reader):
    """The shared strings: of each child of the root the texts in it."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.depth, self.texts = 0, []

    def start(self, tag: str, attributes: dict) -> None:
        if self.depth == 1:
            self.texts = []
        self.held = None
        if tag == MAIN + "t" and self.depth:
            self.held = self.texts
        self.depth += 1

    def end(self, tag: str) -> None:
        self.held = None
        self.depth -= 1
        if self.depth == 1:
            self.out.append("".join(self.texts))

    def close(self) -> list[str]:
        return self.out


class _Sheet(_Reader):
    """A sheet's cells (place, text, number of format) and merged ranges, as they come.

    Cells beyond a block wait in a temporary file: what is merged, and whether the sheet can be read to its
    end, is known only there. The first error of a range, then of a cell, is raised there too.
    """

    def __init__(self, text, formats: list[tuple]) -> None:
        super().__init__()
        self.text, self.formats = text, formats
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.covered: set[tuple[int, int]] = set()
        self.block: list[tuple] = []
        self.file = None
        self.cell: dict | None = None
        self.depth, self.value, self.texts = 0, None, []
        self.bad_range: Exception | None = None
        self.bad_cell: Exception | None = None

    def start(self, tag: str, attributes: dict) -> None:
        if self.cell is not None:
            self.held = None
            if tag == MAIN + "v" and not self.depth and self.value is None:
                self.value = self.held = []
            elif tag == MAIN + "t":
                self.held = self.texts
            self.depth += 1
        elif tag == MAIN + "c":
            self.cell, self.depth, self.value, self.texts = attributes, 0, None, []
        elif tag == MAIN + "mergeCell" and self.bad_range is None:
            try:
                self._merge(attributes.get("ref"))
            except UNREADABLE as e:
                self.bad_range = e

    def end(self, tag: str) -> None:
        self.held = None
        if self.cell is None:
            return
        if self.depth:
            self.depth -= 1
            return
        if self.bad_cell is None:
            try:
                self._add(self.cell)
            except UNREADABLE as e:
                self.bad_cell = e
        self.cell = None

    def close(self) -> None:
        for e in (self.bad_range, self.bad_cell):
            if e is not None:
                raise e

    def _merge(self, ref: str) -> None:
        a, _, b = ref.partition(":")
        (x0, y0), (x1, y1) = _place(a), _place(b or a)
        self.merged[x0, y0] = (x1 - x0 + 1, y1 - y0 + 1)
        self.covered |= {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}

    def _add(self, c: dict) -> None:
        at = _place(c.get("r"))
        text = self.text(c.get("t"), "".join(self.value) or None if self.value is not None else None, self.texts)
        style = int(c.get("s", 0))
        if style < len(self.formats):
            self.formats[style]  # one below 0 may be none
        self.block.append((at, text, style))
        if len(self.block) == BLOCK:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            pickle.dump(self.block, self.file, pickle.HIGHEST_PROTOCOL)
            self.block = []

    def raw(self) -> Iterator[tuple]:
        """The cells in their order, once."""
        if self.file is not None:
            with self.file as f:
                end = f.tell()
                f.seek(0)
                while f.tell() < end:
                    yield from pickle.load(f)
        yield from self.block

    def cells(self) -> Iterator[tuple]:
        """(x, y, w, h, content, style): merged ranges are one cell each, empty ones too; other cells without a value are none."""
        seen = set()
        for at, text, number in self.raw():
            style = self.formats[number] if number < len(self.formats) else None
            if at in self.merged:
                seen.add(at)
                # A merged range's 0 and False count as no content.
                yield *at, *self.merged[at], "" if text in (None, "0", "0.0", "False") else text, style
            elif text is not None and at not in self.covered:
                yield *at, 1, 1, text, style
        for at in self.merged.keys() - seen:
            yield *at, *self.merged[at], "", None


class Workbook:
    """The active sheet of a workbook as cells."""

    def __init__(self, raw: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = set(self.zip.namelist())
        self.strings = self._streamed("xl/sharedStrings.xml", _Strings()) if "xl/sharedStrings.xml" in self.names else []
        self.theme = self._theme()
        self.formats = self._formats()

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name)) if name in self.names else None

    def _streamed(self, name: str, reader: _Reader):
        """What a reader makes of a part of the file, which is unpacked by the block."""
        parser = ElementTree.XMLParser(target=reader)
        with self.zip.open(name) as part:
            try:
                while piece := part.read(1 << 16):
                    parser.feed(piece)
            except ElementTree.ParseError:
                while part.read(1 << 16):  # a damaged file is told from bad XML at its end
                    pass
                raise
            return parser.close()

    def _theme(self) -> list[str]:
        root = self._xml("xl/theme/theme1.xml")
        scheme = None if root is None else root.find(f"{DRAW}themeElements/{DRAW}clrScheme")
        out = []
        for name in THEME if scheme is not None else ():
            c = scheme.find(DRAW + name)[0]
            out.append(c.get("lastClr") if "window" in c.get("val", "") else c.get("val"))
        return out

    def _colour(self, e) -> str | None:
        if e is None:
            return None
        if e.get("rgb"):
            return e.get("rgb")[-6:].upper()
        if e.get("theme") and int(e.get("theme")) < len(self.theme):
            return tinted(self.theme[int(e.get("theme"))], float(e.get("tint", 0)))
        if e.get("indexed"):
            i = int(e.get("indexed"))
            return NUMBERED[i] if i < len(NUMBERED) else f"indexed:{i}"
        return None

    def _formats(self) -> list[tuple]:
        root = self._xml("xl/styles.xml")
        if root is None:
            return []
        kids = lambda tag: list(root.find(MAIN + tag)) if root.find(MAIN + tag) is not None else []
        fonts, fills, borders, out = kids("fonts"), kids("fills"), kids("borders"), []
        for xf in kids("cellXfs"):
            font, fill, border = (some[int(xf.get(k, 0))] if int(xf.get(k, 0)) < len(some) else None for some, k in ((fonts, "fontId"), (fills, "fillId"), (borders, "borderId")))
            marks = [n for n, tag in (("bold", "b"), ("italic", "i"), ("underline", "u")) if font is not None and font.find(MAIN + tag) is not None and font.find(MAIN + tag).get("val", "1") not in ("0", "none")]
            pattern = fill.find(MAIN + "patternFill") if fill is not None else None
            back = self._colour(pattern.find(MAIN + "fgColor")) if pattern is not None and pattern.get("patternType", "none") != "none" else None
            sides = [s for s in SIDES if border is not None and border.find(MAIN + s) is not None and border.find(MAIN + s).get("style")]
            out.append((marks, back, sides, self._colour(font.find(MAIN + "color")) if font is not None else None))
        return out

    def _sheet(self) -> str:
        book = self._xml("xl/workbook.xml")
        views = book.find(MAIN + "bookViews")
        active = int(views[0].get("activeTab", 0)) if views is not None and len(views) else 0
        sheet = book.find(MAIN + "sheets")[active]
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        target = links[sheet.get(REL + "id")]
        return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")

    def _text(self, kind: str | None, v: str | None, texts: list[str]) -> str | None:
        if kind == "inlineStr":
            return "".join(texts)
        if v is None:
            return None
        if kind == "s":
            return self.strings[int(v)]
        if kind == "b":
            return str(v == "1")
        if kind in ("str", "e", "d"):
            return v
        n = float(v)
        return str(int(n)) if n.is_integer() and "." not in v and "E" not in v.upper() else str(n)

    def cells(self) -> Iterator[tuple]:
        """The cells of the sheet as ``_Sheet.cells`` has them; it is read to its end before the first comes."""
        name = self._sheet()
        if name not in self.names:
            raise AttributeError("'NoneType' object has no attribute 'iter'")
        sheet = _Sheet(self._text, self.formats)
        self._streamed(name, sheet)
        return sheet.cells()


def xlsx_cells(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Cells of workbooks given as binary content, in columns CELLS; a file that can't be read gives one row with its error."""
    style = pa.struct([("font_style", pa.list_(pa.string())), ("background_color", pa.string()), ("borders", pa.list_(pa.string())), ("font_color", pa.string())])
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), style, pa.string()]
    names = [c.split(" ")[0] for c in re.split(r", (?=\w+ (?:string|long|int|struct))", CELLS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0), batch.column(1)):
                doc = p.as_py()
                try:
                    found = Workbook(raw.as_py()).cells()
                    rows = ((doc, (y << 32) + x, x, y, w, h, text, dict(zip(("font_style", "background_color", "borders", "font_color"), st)) if st else None, None) for x, y, w, h, text, st in found)
                except UNREADABLE as e:
                    rows = iter([(doc, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")])
                while some := list(itertools.islice(rows, BLOCK)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, CELLS)


def read_xlsx_grids(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks below a path; the documents are named by their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    return xlsx_cells(files)


def unconverted(files: DataFrame) -> DataFrame:
    """Old workbooks (.xls) among paths that no .xlsx of the same name stands beside; those are to be converted first."""
    stem = lambda end: F.regexp_replace("path", rf"(?i)\.{end}$", "")
    old = files.where(F.col("path").rlike(r"(?i)\.xls$")).withColumn("stem", stem("xls"))
    new = files.where(F.col("path").rlike(r"(?i)\.xlsx$")).select(stem("xlsx").alias("stem")).distinct()
    return old.join(new, "stem", "left_anti").drop("stem")
