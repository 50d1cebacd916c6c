"""Areas: their work is done once, and clashes are settled over batches."""

from gridloom.operators import areas
from gridloom.plans import engine
from gridloom.plans.engine import run
from gridloom.plans.grammar import read_grammar
from gridloom.queries import QUERIES
from gridloom.sources.grids import text_cells

CELL = {"o": {"kind": "cell", "content_type": "o"}}
PAIR = CELL | {"two": {"kind": "area", "size": "2 x 1", "inner": {"a": {"pattern": "o"}, "b": {"pattern": "o"}}}}


def _grammar(patterns, *types):
    return read_grammar({"cell_types": [{n: {"patterns": [{"pattern": n, "pattern_syntax": "plain"}]}} for n in types], "patterns": patterns})


def test_areas_are_read_staged(spark):
    """Unstaged, each use of an area did the work again, from the table on."""
    assert not any("events.parquet" in f for f in QUERIES["area_packing"](spark, "/root/testdata/sf0.001").inputFiles())


def test_clashes_are_settled_over_batches(spark, monkeypatch):
    """Documents longer than a batch, and more areas chosen than are held."""
    texts = spark.createDataFrame([(f"d{i}", "o\t" * n + "\n") for i, n in enumerate((2, 5, 8, 3))], "d string, t string")
    monkeypatch.setattr(areas, "CHOSEN", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        m = run(_grammar(PAIR, "o"), text_cells(texts, "d", "t"), everything=True)
        got = sorted((r.doc_id, r.l) for r in m.own["two"].collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [("d0", 0), ("d1", 0), ("d1", 2), ("d2", 0), ("d2", 2), ("d2", 4), ("d2", 6), ("d3", 0)]


def test_arrays_in_context_are_searched_once(spark, monkeypatch):
    """For the area, and not again for the arrays that it is made of."""
    spec = CELL | {"h": {"kind": "cell", "content_type": "h"}, "run": {"kind": "array-in-context", "item_pattern": "o", "direction": "row"}}
    spec |= {"line": {"kind": "area", "size": "2+ x 1", "inner": {"head": {"pattern": "h", "location": "left, top, bottom"}, "rest": {"pattern": "run", "location": "right, top, bottom"}}}}
    plans, real = [], engine.staged

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(engine, "staged", noted)
    m = run(_grammar(spec, "h", "o"), text_cells(spark.createDataFrame([("a", "h\to\to\n")], "d string, t string"), "d", "t"), everything=True)
    assert [(r.l, r.r) for r in m.own["line"].collect()] == [(0, 3)] and m.own["run"].count() == 1
    assert sum("island" in p for p in plans) == 1
