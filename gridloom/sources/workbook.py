"""Workbooks (.xlsx) of one sheet, written with the standard library: cells with a fill colour and a note each."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.operators import reports

#: The name spaces and part types of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
VML = 'xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: No XML holds these, even escaped.
BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
CHOSEN = {"red": "F4A6A0", "amber": "FFE08A", "green": "A9D8A0"}


def _text(s: str) -> str:
    return escape(BARRED.sub("", s))


def _ref(x: int, y: int) -> str:
    letters, n = "", x + 1
    while n:
        n, d = divmod(n - 1, 26)
        letters = chr(65 + d) + letters
    return f"{letters}{y + 1}"


def _links(*parts: tuple[str, str]) -> str:
    rows = "".join(f'<Relationship Id="rId{i}" Type="{REL}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(parts, 1))
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{rows}</Relationships>'


def workbook(cells: Iterable[tuple]) -> bytes:
    """A workbook of cells (x, y, w, h, content, colour, note), which come by row and column.

    Colours are six hexadecimal digits. A null or empty content is no value; larger cells are merged ranges.
    Contents and notes are written whole, but for characters that XML can't hold.
    """
    styles: dict[str | None, int] = {None: 0}
    merged, notes = [], []
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            put = lambda s: sheet.write(s.encode("utf-8"))
            put(f'{HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{REL}"><sheetData>')
            for y, row in itertools.groupby(cells, key=lambda c: c[1]):
                put(f'<row r="{y + 1}">')
                for x, _, w, h, content, colour, note in row:
                    at, style = _ref(x, y), styles.setdefault(colour, len(styles))
                    value = f' t="inlineStr"><is><t xml:space="preserve">{_text(content)}</t></is></c>' if content else "/>"
                    put(f'<c r="{at}" s="{style}"{value}')
                    if (w or 1) > 1 or (h or 1) > 1:
                        merged.append(f"{at}:{_ref(x + w - 1, y + h - 1)}")
                    if note:
                        notes.append((x, y, note))
                put("</row>")
            put("</sheetData>")
            if merged:
                put(f'<mergeCells count="{len(merged)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merged) + "</mergeCells>")
            put('<legacyDrawing r:id="rId2"/></worksheet>' if notes else "</worksheet>")
        fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in styles if c)
        kinds = "".join(f'<xf numFmtId="0" fontId="0" fillId="{i + 1 if c else 0}" borderId="0" xfId="0" applyFill="1"/>' for c, i in styles.items())
        z.writestr(
            "xl/styles.xml",
            f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts><fills count="{len(styles) + 1}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
            f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="{len(styles)}">{kinds}</cellXfs></styleSheet>',
        )
        kinds_of = {"/xl/workbook.xml": f"{SHEET_TYPE}.sheet.main+xml", "/xl/worksheets/sheet1.xml": f"{SHEET_TYPE}.worksheet+xml", "/xl/styles.xml": f"{SHEET_TYPE}.styles+xml"}
        if notes:
            kinds_of["/xl/comments1.xml"] = f"{SHEET_TYPE}.comments+xml"
            listed = "".join(f'<comment ref="{_ref(x, y)}" authorId="0"><text><t xml:space="preserve">{_text(n)}</t></text></comment>' for x, y, n in notes)
            z.writestr("xl/comments1.xml", f'{HEAD}<comments xmlns="{MAIN}"><authors><author/></authors><commentList>{listed}</commentList></comments>')
            shapes = "".join(f'<v:shape type="#n" style="visibility:hidden" fillcolor="#ffffe1"><x:ClientData ObjectType="Note"><x:AutoFill>False</x:AutoFill><x:Row>{y}</x:Row><x:Column>{x}</x:Column></x:ClientData></v:shape>' for x, y, _ in notes)
            z.writestr("xl/drawings/vmlDrawing1.vml", f'<xml {VML}><v:shapetype id="n" coordsize="21600,21600" o:spt="202" path="m,l,21600r21600,l21600,xe"/>{shapes}</xml>')
            z.writestr("xl/worksheets/_rels/sheet1.xml.rels", _links(("comments", "../comments1.xml"), ("vmlDrawing", "../drawings/vmlDrawing1.vml")))
        parts = "".join(f'<Override PartName="{n}" ContentType="{k}"/>' for n, k in kinds_of.items())
        z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/>{parts}</Types>')
        z.writestr("_rels/.rels", _links(("officeDocument", "xl/workbook.xml")))
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", _links(("worksheet", "worksheets/sheet1.xml"), ("styles", "styles.xml")))
    return raw.getvalue()


def workbooks(cells: DataFrame, paint: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): a workbook of each document's cells, painted by (doc_id, x, y, colour, note).

    Painted points that no cell begins at are written as empty cells. Rows stream through a task by
    document; only a sheet's packed bytes, merged ranges and notes are held.
    """
    kind = dict(cells.dtypes)["doc_id"]
    rows = cells.where("x is not null and y is not null").select("doc_id", "x", "y", "w", "h", "content")
    if paint is None:
        rows = rows.selectExpr("*", "cast(null as string) as colour", "cast(null as string) as note")
    else:
        rows = rows.join(paint.select("doc_id", "x", "y", "colour", "note"), ["doc_id", "x", "y"], "full")
    lined = rows.select("doc_id", "x", "y", "w", "h", "content", "colour", "note").repartition("doc_id").sortWithinPartitions("doc_id", "y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((b.schema.field(0).type, row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for doc, mine in itertools.groupby(each, key=lambda r: (r[1][0], r[0])):
            made = workbook(r[1:] for _, r in mine)
            yield pa.RecordBatch.from_arrays([pa.array([doc[0]], doc[1]), pa.array([made], pa.binary())], ["doc_id", "content"])

    return lined.mapInArrow(run, f"doc_id {kind}, content binary")


def confidence_workbooks(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Workbooks painted by how sure each cell's type is, with its likely types as a note."""
    marks = reports.confidence_colours(found).replace(CHOSEN, subset=["colour"])
    return workbooks(cells, marks.join(cells.select("doc_id", "cell_id", "x", "y"), ["doc_id", "cell_id"]))


def match_workbooks(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """Workbooks painted by the pattern of each point's best match, with the matches that begin at a point as its note."""
    return workbooks(cells, reports.painted(matches))
