"""Projections and filters of grids: cells (doc_id, cell_id, x, y, w, h, content, ...) with merged cells as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scan directions as the two sort keys, slow one first: each a coordinate and its sign.
DIRECTIONS = {"right": ("x", 1), "left": ("x", -1), "down": ("y", 1), "up": ("y", -1)}


def cell_box(prefix: str = "") -> Column:
    """A cell's box, its right and bottom exclusive."""
    x, y, w, h = (F.col(prefix + c) for c in "xywh")
    return F.struct(x.alias("l"), y.alias("t"), (x + w).alias("r"), (y + h).alias("b"))


def bounding_boxes(cells: DataFrame) -> DataFrame:
    """(doc_id, l, t, r, b) around all cells of each document."""
    return cells.groupBy("doc_id").agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))


def cell_at(cells: DataFrame, x: int, y: int) -> DataFrame:
    """The cell over a point, in each document; none outside."""
    return cells.where((F.col("x") <= x) & (F.lit(x) < F.col("x") + F.col("w")) & (F.col("y") <= y) & (F.lit(y) < F.col("y") + F.col("h")))


def view(cells: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """The cells that share a point with a region."""
    return cells.where((F.col("x") < right) & (F.col("x") + F.col("w") > left) & (F.col("y") < bottom) & (F.col("y") + F.col("h") > top))


def clipped_regions(cells: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Each document's part of a region; none where they don't meet."""
    box = bounding_boxes(cells)
    cut = box.select("doc_id", F.greatest("l", F.lit(left)).alias("l"), F.greatest("t", F.lit(top)).alias("t"), F.least("r", F.lit(right)).alias("r"), F.least("b", F.lit(bottom)).alias("b"))
    return cut.where("l < r and t < b")


def ordered(cells: DataFrame, first: str = "right", then: str = "down") -> DataFrame:
    """Adds ``pos``, from 1: the cell's place when lines run ``first`` and follow one another ``then``."""
    (fast, a), (slow, b) = DIRECTIONS[first], DIRECTIONS[then]
    if fast == slow:
        raise ValueError("two different axes are needed")
    w = Window.partitionBy("doc_id").orderBy(F.col(slow) * b, F.col(fast) * a, "cell_id")
    return cells.withColumn("pos", F.row_number().over(w))


def find_cells(cells: DataFrame, predicate: Column) -> DataFrame:
    return cells.where(predicate)


def find_cell(cells: DataFrame, predicate: Column, first: str = "right", then: str = "down") -> DataFrame:
    """In each document the first cell that a predicate holds for, in scan order."""
    return ordered(cells.where(predicate), first, then).where("pos = 1").drop("pos")


def look_outside(cells: DataFrame, side: str, left: int, top: int, right: int, bottom: int, distance: int = 1) -> DataFrame:
    """The cells in the strip along one side of a region, ``distance`` wide (below 0: up to the grid's border)."""
    far = 1 << 30
    d = far if distance < 0 else distance
    strips = {"left": (left - d, top, left, bottom), "right": (right, top, right + d, bottom), "top": (left, top - d, right, top), "bottom": (left, bottom, right, bottom + d)}
    return view(cells, *strips[side])


def points(boxes: DataFrame) -> DataFrame:
    """Boxes (l, t, r, b) exploded into their points (px, py); a box without area has none."""
    some = boxes.where("l < r and t < b")
    return some.withColumn("px", F.explode(F.sequence("l", F.col("r") - 1))).withColumn("py", F.explode(F.sequence("t", F.col("b") - 1)))


def ordered_points(boxes: DataFrame, first: str = "right", then: str = "down", exclude_top_left: bool = False) -> DataFrame:
    """The boxes' points with ``pos``, from 1: a point's place when lines run ``first`` and follow one another ``then``.

    ``then`` on the axis of ``first`` stands for the other axis' usual way. Without the top left point the
    places of the others stay.
    """
    if DIRECTIONS[then][0] == DIRECTIONS[first][0]:
        then = "down" if DIRECTIONS[first][0] == "x" else "right"
    steps, width = {"right": F.col("px") - F.col("l"), "left": F.col("r") - 1 - F.col("px"), "down": F.col("py") - F.col("t"), "up": F.col("b") - 1 - F.col("py")}, {"x": F.col("r") - F.col("l"), "y": F.col("b") - F.col("t")}
    out = points(boxes).withColumn("pos", steps[then] * width[DIRECTIONS[first][0]] + steps[first] + 1)
    return out.where("px <> l or py <> t") if exclude_top_left else out


def unique_values(cells: DataFrame) -> DataFrame:
    """The distinct stripped contents of all cells, without empty ones, in order."""
    return cells.select(F.trim("content").alias("content")).where("content <> ''").distinct().orderBy("content")


def corners(boxes: DataFrame, diagonal: bool = False) -> DataFrame:
    """Boxes (l, t, r, b) exploded into their corners (corner, px, py): clockwise from the top left, or the first and third of these."""
    ends = [("l", "t"), ("r", "t"), ("r", "b"), ("l", "b")][:: 2 if diagonal else 1]
    return boxes.select("*", F.posexplode(F.array(*[F.struct(F.col(x).alias("px"), F.col(y).alias("py")) for x, y in ends])).alias("corner", "p")).select(*boxes.columns, "corner", "p.px", "p.py")


def box_order(boxes: DataFrame, *keys: str) -> DataFrame:
    """Adds ``pos``, from 1: a box's place among those of its keys, by left, top, width and height."""
    w = Window.partitionBy(*keys).orderBy("l", "t", F.col("r") - F.col("l"), F.col("b") - F.col("t"))
    return boxes.withColumn("pos", F.row_number().over(w))
