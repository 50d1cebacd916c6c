"""Workbooks written and read again, and jobs over folders of them."""

import io
import json
import zipfile
from xml.etree import ElementTree

from gridloom.operators.classify import merged, static_fields
from gridloom.plans.jobs import run_folder
from gridloom.sources.files import write_files
from gridloom.sources.sinks import rebuild_metadata
from gridloom.sources.workbook import confidence_workbooks, workbook, workbooks
from gridloom.sources.xlsx import Workbook, read_xlsx_grids
from pyspark.sql import functions as F

TYPES = {
    "title": "Расписание.*", "group": r"[А-Я]-\d", "day": "СРЕДА|ВТОРНИК", "month": "сентябрь|октябрь", "number": r"\d{1,2}", "hours": r"\d-\d ч", "subject": "[А-Я][а-я]{4,}",
}
GRAMMAR = {
    "cell_types": [{n: {"patterns": [{"pattern": p, "confidence": 1.0, "anchors": "both"}]}} for n, p in TYPES.items()],
    "patterns": {n: {"kind": "cell", "content_type": n} for n in TYPES}
    | {
        "groups": {"kind": "area", "inner": {"groups": {"pattern": "group_row"}}},
        "group_row": {"kind": "array", "item_pattern": "group", "direction": "row", "item_count": "2+"},
        "a_date": {"kind": "area", "size": "2 x 1", "inner": {"month_name": {"pattern": "month", "location": "left, top, bottom"}, "month_day": {"pattern": "number", "location": "right, top, bottom"}}},
        "date_row": {"kind": "array", "item_pattern": "a_date", "direction": "row"},
        "date_rows": {"kind": "array", "item_pattern": "date_row", "direction": "column"},
        "a_day": {"kind": "area", "size": "3+ x 1", "inner": {"week_day": {"pattern": "day", "location": "left, top, bottom"}, "month_days": {"pattern": "date_rows", "location": {"left": 1, "right": 0, "top": 0, "bottom": 0}}}},
        "days": {"kind": "array", "item_pattern": "a_day", "direction": "column"},
        "a_week": {"kind": "area", "inner": {"_days": {"pattern": "days", "location": "left, top, right, bottom"}}},
        "weeks": {"kind": "array", "item_pattern": "a_week", "direction": "column", "gap": "0+", "index_items": True},
        "datetime": {"kind": "area", "inner": {"weeks": {"pattern": "weeks", "location": "left, top, right, bottom"}}},
        "discipline": {"kind": "area", "size": "2 x 1", "inner": {"discipline": {"pattern": "subject", "location": "left, top, bottom"}, "group": {"pattern": "one_group", "location": "right, top, bottom"}}},
        "one_group": {"kind": "area", "inner": {"group": {"pattern": "group", "location": "left, top, right, bottom"}}},
        "frame": {"kind": "area", "static_data": {"_explicit_lesson_kind": "Лаб."}, "size": "3 x 1", "inner": {"discipline": {"pattern": "discipline", "location": "left, top, bottom"}, "hour_1": {"pattern": "hours", "location": "right, top, bottom"}}},
        "lesson": {"kind": "area", "inner": {"frame": {"pattern": "frame", "location": "left, top, right, bottom"}}},
        "lessons": {"kind": "array", "item_pattern": "lesson", "direction": "column", "gap": "0+"},
        "table": {"kind": "area", "inner": {"groups": {"pattern": "groups"}, "datetime": {"pattern": "datetime"}, "grid": {"pattern": "lessons"}}},
        "root": {"kind": "area", "root": True, "inner": {"title": {"pattern": "title"}, "table": {"pattern": "table"}}},
    },
}
SHEET = [
    (0, 0, 3, 1, "Расписание ФЭВТ 2 курс"), (5, 1, 1, 1, "А-1"), (6, 1, 1, 1, "А-2"),
    (0, 2, 1, 1, "СРЕДА"), (1, 2, 1, 1, "сентябрь"), (2, 2, 1, 1, "3"), (5, 2, 1, 1, "Физика"), (6, 2, 1, 1, "А-1"), (7, 2, 1, 1, "1-2 ч"), (12, 2, 1, 1, "19"),
]


def book(rows):
    return workbook((*r, None, None) for r in rows)


def test_workbook_round_trip():
    raw = workbook([(0, 0, 2, 1, "a <b> & \x07c", "FF0000", "note\n1"), (3, 0, 1, 1, " x ", None, None), (27, 4, 1, 2, "", "00FF00", None)])
    names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
    for n in names:
        ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read(n))
    assert "xl/comments1.xml" in names and "xl/drawings/vmlDrawing1.vml" in names
    got = {c[:5]: c[5][1] for c in Workbook(raw).cells()}
    assert got == {(0, 0, 2, 1, "a <b> & c"): "FF0000", (3, 0, 1, 1, " x "): None, (27, 4, 1, 2, ""): "00FF00"}
    assert list(Workbook(workbook([])).cells()) == []


def test_workbooks(spark):
    cells = spark.createDataFrame([("a", 1, 0, 0, 1, 1, "u"), ("a", 2, 3, 2, 2, 1, "v"), ("b", 1, 0, 0, 1, 1, None)], "doc_id string, cell_id long, x int, y int, w int, h int, content string")
    paint = spark.createDataFrame([("a", 0, 0, "ABCDEF", "n"), ("a", 9, 9, "123456", None)], "doc_id string, x int, y int, colour string, note string")
    got = {r.doc_id: list(Workbook(bytes(r.content)).cells()) for r in workbooks(cells, paint).collect()}
    assert [(c[0], c[1], c[4], c[5][1]) for c in got["a"]] == [(0, 0, "u", "ABCDEF"), (3, 2, "v", None)] and got["b"] == []
    found = spark.createDataFrame([("a", 1, "t", 0.9), ("a", 2, "t", 0.4), ("a", 2, "s", 0.3)], "doc_id string, cell_id long, cell_type string, precision double")
    (one,) = confidence_workbooks(cells, found).where("doc_id = 'a'").collect()
    assert [c[5][1] for c in Workbook(bytes(one.content)).cells()] == ["A9D8A0", "F4A6A0"]


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([("x/1.txt", "é"), (None, "n"), ("../out", "n"), ("2", None), ("3", "")], "name string, content string")
    got = {r.name: (r.bytes, r.error) for r in write_files(rows, str(tmp_path)).collect()}
    assert got["x/1.txt"] == (2, None) and got["3"] == (0, None) and all(got[n][1] for n in (None, "../out", "2"))
    assert (tmp_path / "x/1.txt").read_text("utf-8") == "é" and not list(tmp_path.rglob("*.part"))


def test_merged(spark):
    def of(content, fields):
        return json.loads(spark.range(1).select(merged(F.lit(content), fields)).first()[0])

    fields = static_fields({"k": 1, "d": [2]})
    assert of('{"k":9,"z":0}', fields) == {"d": [2], "k": 9, "z": 0} and of("{}", fields) == {"k": 1, "d": [2]}
    assert of('"t"', fields) == {"k": 1, "d": [2], "@content": "t"} and of("[1]", []) == [1]


def test_run_folder(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "Магистратура").mkdir(parents=True)
    (source / "Магистратура" / "ФЭВТ 2.xlsx").write_bytes(book(SHEET))
    (source / "none.xlsx").write_bytes(book([(0, 0, 1, 1, "19")]))
    (source / "bad.xlsx").write_bytes(b"no workbook")
    done = {r.doc_id.rpartition("/")[2]: (r.ok, r.error) for r in run_folder(spark, GRAMMAR, str(source), str(target), extras=True, timetable=True).collect()}
    assert done["ФЭВТ 2.xlsx"] == (True, None) and done["none.xlsx"] == (False, "no root") and "BadZipFile" in done["bad.xlsx"][1]
    read = lambda end: json.loads((target / "Магистратура" / f"ФЭВТ 2{end}").read_text("utf-8"))
    content = read(".json")
    assert content["title"] == "Расписание ФЭВТ 2 курс" and content["table"]["groups"] == {"groups": ["А-1", "А-2"]}
    assert content["table"]["datetime"]["weeks"] == [{"@index_in_array": 1}]
    assert content["table"]["grid"][0]["frame"]["_explicit_lesson_kind"] == "Лаб."
    tree = read(".tree.json")
    assert tree["pattern"] == "root" and {c["name"] for c in tree["components"]} == {"title", "table"}
    unused = read(".unused.json")
    # The table's head matches a lesson's group too, which no lesson is made of.
    assert unused["pattern_counts"] == {"number": 1, "one_group": 2} and unused["total"] == 3 and any(m["content"] == '"19"' for m in unused["matches"])
    painted = read_xlsx_grids(spark, str(target)).where("style.background_color is not null").collect()
    assert sorted((r.x, r.y, r.content) for r in painted if "2.unused" in r.doc_id) == [(5, 1, "А-1"), (6, 1, "А-2"), (12, 2, "19")]
    assert sum(read(".wave_00.json")["pattern_counts"].values()) == 10 and (target / "bad.issues.json").exists() and not (target / "bad.json").exists()
    t = read(".timetable.json")
    (lesson,) = t["table"]["grid"]
    assert (lesson["subject"], lesson["participants"]["student_groups"], lesson["hours"], lesson["week"]) == ("Физика", ["А-1"], ["1-2"], "first_week")
    assert t["table"]["datetime"]["weeks"]["first_week"] == [{"week_day_index": 2, "calendar": [{"month_index": 0, "month_days": ["3"]}]}]
    rebuild_metadata(spark, str(target), str(tmp_path / "meta"))
    assert any("ФЭВТ" in line for f in (tmp_path / "meta").glob("*.json") for line in f.read_text("utf-8").splitlines())


def test_numbered_colours():
    raw = workbook([(0, 0, 1, 1, "a", "FF0000", None)])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            w.writestr(n, z.read(n).replace(b'rgb="FFFF0000"', b'indexed="23"'))
    assert [c[5][1] for c in Workbook(out.getvalue()).cells()] == ["808080"]
