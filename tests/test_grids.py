"""Grids end to end: sources, matching of small grammars, reports, streaming."""

import json
import os
import shutil
import subprocess
import sys
import zipfile

import pytest

from gridloom.operators import reports
from gridloom.plans.engine import run
from gridloom.plans.grammar import read_grammar
from gridloom.plans.service import DocumentParser
from gridloom.sources.grids import text_cells
from gridloom.sources.xlsx import read_xlsx_grids, tinted, unconverted
from gridloom.streaming.ingest import parse_arrivals

BOARD = "\tA\tB\tC\tD\n4\t\to\t\t*\n3\t\t\to\t\n2\t*\t\t\to\n1\t\t*\t\t\n"
GRAMMAR = {
    "cell_types": [{"letter": {"patterns": [{"pattern": "[A-H]", "confidence": 1.0}]}}, {"digit": {"patterns": [{"pattern": r"\d", "confidence": 1.0}]}}, {"ring": {"patterns": [{"pattern": "o", "confidence": 1.0}]}}, {"star": {"patterns": [{"pattern": "[*]", "confidence": 1.0}]}}],
    "patterns": {
        "letter": {"kind": "cell", "content_type": "letter"},
        "digit": {"kind": "cell", "content_type": "digit"},
        "mark": {"kind": "general"},
        "ring": {"kind": "cell", "content_type": "ring", "extends": ["mark"]},
        "star": {"kind": "cell", "content_type": "star", "extends": ["mark"]},
        "letters": {"kind": "array", "item_pattern": "letter", "item_count": "2+"},
        "digits": {"kind": "array", "item_pattern": "digit"},
        "field": {"kind": "array", "item_pattern": "mark", "direction": "fill", "gap": "3-", "item_count": "2+"},
        "root": {"kind": "area", "root": True, "count_in_document": 1, "inner": {"field": {"pattern": "field"}, "digits": {"pattern": "digits"}, "letters": {"pattern": "letters"}}},
    },
}


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "d string, t string")


def boxes(df):
    return sorted((r.l, r.t, r.r - r.l, r.b - r.t) for r in df.collect())


def test_text_cells(spark):
    got = {(r.doc_id, r.x, r.y, r.content) for r in text_cells(docs(spark, ("a", "x\t\ty\r\n z\n"), ("b", ""), ("c", None)), "d", "t").collect()}
    assert got == {("a", 0, 0, "x"), ("a", 2, 0, "y"), ("a", 0, 1, " z")}
    chars = {(r.x, r.y, r.content) for r in text_cells(docs(spark, ("a", "p q\nr")), "d", "t", "").collect()}
    assert chars == {(0, 0, "p"), (1, 0, " "), (2, 0, "q"), (0, 1, "r")}


def test_board(spark):
    cells = text_cells(docs(spark, ("a", BOARD), ("b", BOARD.replace("A", "?")), ("c", "nothing")), "d", "t")
    parser = DocumentParser(read_grammar(GRAMMAR))
    m = parser.parse(cells)
    roots = {r.doc_id: r for r in m.roots().collect()}
    assert set(roots) == {"a", "b"} and (roots["a"].l, roots["a"].t, roots["a"].r, roots["a"].b) == (0, 0, 5, 5)
    content = json.loads(roots["a"].content)
    assert content["letters"] == list("ABCD") and content["digits"] == list("4321") and sorted(content["field"]) == ["*", "*", "*", "o", "o", "o"]
    assert json.loads(roots["b"].content)["letters"] == list("BCD")
    assert parser.unused(m).where("doc_id = 'a'").count() == 0
    shown = {r.doc_id: json.loads(r.json) for r in parser.diagnostics(m, cells).collect()}
    assert shown["a"]["summary"] == {"errors": 0, "warnings": 0, "infos": 0} and set(shown) == {"a", "b", "c"}
    same = run(parser.grammar, cells.repartition(7), stage=False)
    assert sorted(map(str, same.roots().select("doc_id", "l", "t", "content").collect())) == sorted(map(str, m.roots().select("doc_id", "l", "t", "content").collect()))
    every = m.all()
    assert reports.serialised(every).where("json like '%\"component_count\":3%'").count() == 3


def test_empty_cells(spark):
    cells = text_cells(docs(spark, ("a", None)), "d", "t")
    assert run(read_grammar(GRAMMAR), cells).roots().count() == 0


def one_type(*names):
    return [{n: {"patterns": [{"pattern": n, "pattern_syntax": "plain", "confidence": 1.0}]}} for n in names]


def test_context_components(spark):
    """Cells with water beside them on a given side, and their coast."""
    land = {"kind": "area", "extends": ["beach"], "inner": {"sand": {"pattern": "s", "location": "left, right, top, bottom"}}}
    g = read_grammar({"cell_types": one_type("s", "w"), "patterns": {"s": {"kind": "cell", "content_type": "s"}, "w": {"kind": "cell", "content_type": "w"}, "beach": {"kind": "general"}, "left": land | {"outer": {"sea": {"pattern": "w", "location": {"left": 0}}}}, "right": land | {"outer": {"sea": {"pattern": "w", "location": {"right": 0}}}}, "coast": {"kind": "array", "direction": "fill", "item_pattern": "beach"}}})
    cells = text_cells(docs(spark, ("a", "w\ts\ts\tw\nw\ts\ts\tw\n")), "d", "t")
    m = run(g, cells, everything=True)
    assert boxes(m.own["left"]) == [(1, 0, 1, 1), (1, 1, 1, 1)] and boxes(m.own["right"]) == [(2, 0, 1, 1), (2, 1, 1, 1)]
    assert boxes(m.own["coast"]) == [(1, 0, 2, 2)]


def test_count_of_none(spark):
    """A lower bound is missed by documents without any match too."""
    g = read_grammar({"cell_types": one_type("o", "x"), "patterns": {"o": {"kind": "cell", "content_type": "o"}, "x": {"kind": "cell", "content_type": "x"}, "some": {"kind": "area", "root": True, "count_in_document": "1+", "inner": {"s": {"pattern": "o"}}}}})
    m = run(g, text_cells(docs(spark, ("a", "o\tx"), ("b", "x\tx")), "d", "t"))
    assert [(r.doc_id, r.code, r.actual) for r in m.issues().collect()] == [("b", "PATTERN_COUNT_MISMATCH", "0")]


def test_packing_and_breakdown(spark):
    square = {f"p{x}{y}": {"pattern": "o", "location": {"left": x, "top": y, "right": 1 - x, "bottom": 1 - y}} for x in (0, 1) for y in (0, 1)}
    g = read_grammar({"cell_types": one_type("o"), "patterns": {"o": {"kind": "cell", "content_type": "o"}, "four": {"kind": "area", "size": "2 x 2", "inner": square}, "parts": {"kind": "array", "direction": "fill", "item_pattern": "o", "allow_breakdown": True, "size": "3- x 1"}}})
    m = run(g, text_cells(docs(spark, ("a", "o\to\to\to\no\to\to\to\n")), "d", "t"), everything=True)
    assert boxes(m.own["four"]) == [(0, 0, 2, 2), (2, 0, 2, 2)]
    got = boxes(m.own["parts"])
    assert sum(w for _, _, w, _ in got) == 8 and all(w <= 3 and h == 1 for _, _, w, h in got) and len(got) == 4


def test_array_in_context(spark):
    spec = {"h": {"kind": "cell", "content_type": "h"}, "o": {"kind": "cell", "content_type": "o"}, "run": {"kind": "array-in-context", "item_pattern": "o", "direction": "row"}, "line": {"kind": "area", "size": "2+ x 1", "inner": {"head": {"pattern": "h", "location": "left, top, bottom"}, "rest": {"pattern": "run", "location": "right, top, bottom"}}}}
    g = read_grammar({"cell_types": one_type("h", "o"), "patterns": spec})
    m = run(g, text_cells(docs(spark, ("a", "o\th\to\to\n\t\n\to\th\to\n")), "d", "t"), everything=True)
    assert boxes(m.own["line"]) == [(1, 0, 3, 1), (2, 2, 2, 1)]


def test_array_in_context_is_registered(spark):
    """The arrays that areas are made of are matches too, each once, and lead to their cells."""
    spec = {"h": {"kind": "cell", "content_type": "h"}, "o": {"kind": "cell", "content_type": "o"}, "run": {"kind": "array-in-context", "item_pattern": "o", "direction": "row"}, "line": {"kind": "area", "root": True, "size": "2+ x 1", "inner": {"head": {"pattern": "h", "location": "left, top, bottom"}, "rest": {"pattern": "run", "location": "right, top, bottom"}}}}
    parser = DocumentParser(read_grammar({"cell_types": one_type("h", "o"), "patterns": spec}))
    m = parser.parse(text_cells(docs(spark, ("a", "o\th\to\to\n\t\n\to\th\to\n")), "d", "t"))
    assert boxes(m.lookup("run")) == [(2, 0, 2, 1), (3, 2, 1, 1)]
    assert boxes(parser.unused(m)) == [(0, 0, 1, 1), (1, 2, 1, 1)]
    assert reports.serialised(m.all()).where("json like '%\"pattern\":\"run\",\"box\"%'").count() == 2


def write_xlsx(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="x" r:id="r1"/><sheet name="y" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>merged</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts><font/><font><b/><color rgb="FF00FF00"/></font></fonts><fills><fill/><fill><patternFill patternType="solid"><fgColor rgb="FFFF0000"/></patternFill></fill></fills><borders><border/><border><left style="thin"/></border></borders><cellXfs><xf/><xf fontId="1" fillId="1" borderId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row><c r="B3" t="s" s="1"><v>1</v></c><c r="D1" t="s"><v>0</v></c><c r="E2"><v>9</v></c><c r="A1"><v>2.5</v></c><c r="C3"/><c r="F1"><v>0</v></c></row></sheetData><mergeCells><mergeCell ref="D1:E3"/><mergeCell ref="F1:F2"/><mergeCell ref="A5:B5"/></mergeCells></worksheet>')


def test_xlsx(spark, tmp_path):
    write_xlsx(tmp_path / "a.xlsx")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows = read_xlsx_grids(spark, str(tmp_path)).collect()
    got = {(r.x, r.y, r.w, r.h, r.content) for r in rows if r.error is None}
    assert got == {(1, 2, 1, 1, "rich"), (3, 0, 2, 3, "merged"), (0, 0, 1, 1, "2.5"), (5, 0, 1, 2, ""), (0, 4, 2, 1, "")}
    style = next(r.style for r in rows if r.content == "rich")
    assert (style.font_style, style.background_color, style.borders, style.font_color) == (["bold"], "FF0000", ["left"], "00FF00")
    assert len([r for r in rows if r.error]) == 1
    parser = DocumentParser(read_grammar(GRAMMAR))
    cells = read_xlsx_grids(spark, str(tmp_path))
    found = [(r.doc_id.rsplit("/", 1)[-1], r.severity, r.code, r.pattern_name, r.actual) for r in parser.parse(cells).issues().collect()]
    # The sheet that can be read has no root, of which one is wanted; the other isn't counted.
    assert sorted(found) == [("a.xlsx", "warning", "PATTERN_COUNT_MISMATCH", "root", "0"), ("bad.xlsx", "error", "PARSE_EXCEPTION", None, None)]
    assert tinted("FFFFFF", -0.5) == "808080" and tinted("000000", 0.0) == "000000"
    files = spark.createDataFrame([("x/a.xls",), ("x/a.xlsx",), ("x/b.XLS",)], "path string")
    assert [r.path for r in unconverted(files).collect()] == ["x/b.XLS"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text(BOARD)
    parser = DocumentParser(read_grammar(GRAMMAR))
    for name in ("b", None):
        q = parse_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), parser)
        q.awaitTermination()
        if name:
            (tmp_path / f"in/{name}.tsv").write_text(BOARD)
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 2 and got.where("json like '%letters%'").count() == 2


@pytest.mark.parametrize("folders", [["gridloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, folders):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".hypothesis", ".pytest_cache"))
    for f in folders:
        p = tmp_path / "r" / f
        shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'array_row' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_tiled_blocks(spark):
    """Blocks of nine located components, some side by side: of all that overlap the most that fit together stay."""
    at = [(1, 2), (1, 5), (4, 4), (4, 7), (6, 1)]
    full = {(x + i, y + j) for x, y in at for i in range(3) for j in range(3)}
    board = "\n".join("\t".join("o" if (x, y) in full else "" for x in range(9)) for y in range(10))
    inner = {f"c{i}{j}": {"pattern": "ring", "location": {"left": i, "top": j}} for j in range(3) for i in range(3)}
    data = {"cell_types": GRAMMAR["cell_types"], "patterns": {"ring": {"kind": "cell", "content_type": "ring"}, "block": {"kind": "area", "root": True, "size": "3 x 3", "inner": inner}}}
    found = run(read_grammar(data), text_cells(docs(spark, ("a", board)), "d", "t"))
    assert boxes(found.lookup("block")) == sorted((x, y, 3, 3) for x, y in at)


def test_islands_and_beaches(spark):
    """Land of two kinds of cells in the water, and the water beside it, from left and right."""
    sea = ["~~~~~~~~", "~~~~~~~~", "~~#T##~~", "~~T~~#~~", "~~#TT#~~", "~~~~~~~~"]
    types = [{n: {"patterns": [{"pattern": s, "pattern_syntax": "plain", "confidence": 1.0}]}} for n, s in (("water", "~"), ("sand", "#"), ("tree", "T"))]
    side = lambda s: {"kind": "area", "inner": {"land": {"pattern": "earth", "location": "left, top, right, bottom"}}, "outer": {"sea": {"pattern": "water", "location": {s: 0}}}}
    patterns = {n: {"kind": "cell", "content_type": n, "extends": [] if n == "water" else ["earth"]} for n in ("water", "sand", "tree")}
    patterns |= {"earth": {"kind": "general"}, "island": {"kind": "array", "item_pattern": "earth", "direction": "fill", "item_count": "2+"}, "beach_l": side("left"), "beach_r": side("right")}
    found = run(read_grammar({"cell_types": types, "patterns": patterns}), text_cells(docs(spark, ("a", "\n".join(sea))), "d", "t", ""), everything=True)
    assert boxes(found.lookup("island")) == [(2, 2, 4, 3)]
    assert boxes(found.lookup("beach_l")) == [(2, 2, 1, 1), (2, 3, 1, 1), (2, 4, 1, 1), (5, 3, 1, 1)]
    assert boxes(found.lookup("beach_r")) == [(2, 3, 1, 1), (5, 2, 1, 1), (5, 3, 1, 1), (5, 4, 1, 1)]


def test_groups_over_many_batches(spark):
    """Groups that go over many Arrow batches are clustered whole."""
    grid = "\n".join("\t".join("o" if (x // 3 + y) % 2 else "" for x in range(30)) for y in range(20))
    data = {"cell_types": GRAMMAR["cell_types"], "patterns": {"ring": {"kind": "cell", "content_type": "ring"}, "runs": {"kind": "array", "item_pattern": "ring", "direction": "row", "item_count": "1..2", "allow_breakdown": True}}}
    cells = text_cells(docs(spark, *[(n, grid) for n in "abc"]), "d", "t")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = sorted(map(tuple, run(read_grammar(data), cells, everything=True).lookup("runs").select("doc_id", "l", "t", "r", "b").collect()))
    spark.conf.set(size, 7)
    try:
        assert sorted(map(tuple, run(read_grammar(data), cells, everything=True).lookup("runs").select("doc_id", "l", "t", "r", "b").collect())) == whole
    finally:
        spark.conf.unset(size)
    assert len(whole) == 3 * 20 * 5 * 2 and {r[3] - r[1] for r in whole} == {1, 2}
