"""Sheets are read by the block, whatever their size."""

import io
import tracemalloc
import zipfile

import pytest

from gridloom.sources import xlsx
from gridloom.sources.workbook import workbook


def test_a_sheet_is_read_by_the_block():
    """As a tree of elements this sheet takes 79 MB."""
    raw = workbook((x, y, 1, 1, f"{x} {y}", None, None) for y in range(20_000) for x in range(3))
    tracemalloc.start()
    try:
        assert sum(1 for _ in xlsx.Workbook(raw).cells()) == 60_000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8_000_000


@pytest.mark.parametrize("block", [7, 10_000])
def test_a_sheet_with_an_error_at_its_end_has_no_cells(spark, monkeypatch, block):
    """Blocks wait until the sheet is read; merged ranges come after the cells."""
    monkeypatch.setattr(xlsx, "BLOCK", block)
    whole = workbook((x, y, 2 if (x, y) == (1, 3) else 1, 1, f"{x} {y}", None, None) for y in range(20) for x in (1, 4))
    found = list(xlsx.Workbook(whole).cells())
    assert len(found) == 40 and [c[:5] for c in found if c[2] == 2] == [(1, 3, 2, 1, "1 3")]
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            new.writestr(n, old.read(n).replace(b"</sheetData>", b'<row><c r="A21"><v>x</v></c></row></sheetData>'))
    files = spark.createDataFrame([("bad", out.getvalue()), ("good", whole)], "path string, content binary")
    got = xlsx.xlsx_cells(files).collect()
    assert [r.error for r in got if r.doc_id == "bad"] == ["ValueError: could not convert string to float: 'x'"]
    assert sum(r.doc_id == "good" for r in got) == 40
