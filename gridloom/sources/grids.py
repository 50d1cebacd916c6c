"""Grids from text files and from any table: cells (doc_id, cell_id, x, y, w, h, content, style)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STYLE = "struct<font_style:array<string>,background_color:string,borders:array<string>,font_color:string>"
#: The line ends that text grids know.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def as_cells(df: DataFrame, w: Column | int = 1, h: Column | int = 1) -> DataFrame:
    """Rows (doc_id, x, y, content) as cells of size 1 x 1; cell_id follows the scan order."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "doc_id",
        (F.shiftleft(F.col("y").cast("long"), 32) + F.col("x")).alias("cell_id"),
        F.col("x").cast("int").alias("x"),
        F.col("y").cast("int").alias("y"),
        lit(w).cast("int").alias("w"),
        lit(h).cast("int").alias("h"),
        F.col("content").cast("string").alias("content"),
        F.lit(None).cast(STYLE).alias("style"),
    )


def text_cells(df: DataFrame, key: str, text: str, sep: str = "\t") -> DataFrame:
    """Cells of texts: a line is a row of the grid, an item between ``sep`` a cell; empty items are none.

    With an empty ``sep`` each character is a cell, blanks too. A line end at the end of a text makes no
    further line; null texts have no cells.
    """
    trimmed = F.regexp_replace(F.col(text), f"(?:{LINE_END})\\z", "")
    lines = df.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.posexplode(F.split(trimmed, LINE_END)).alias("y", "line"))
    parts = F.split("line", f"\\Q{sep}\\E") if sep else F.filter(F.split("line", ""), lambda c: c != "")
    items = lines.select("doc_id", "y", F.posexplode(parts).alias("x", "content")).where("content <> ''")
    return as_cells(items)


def read_text_grids(spark: SparkSession, path: str, sep: str = "\t", pattern: str = "*.tsv") -> DataFrame:
    """Cells of all text files below a path, each a document named by its path."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return text_cells(files.select(F.input_file_name().alias("path"), "value"), "path", "value", sep)


def table_cells(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """A table as grids: rows of one key make a document, in ``order``; each column is a column of the grid."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("__y", F.row_number().over(w) - 1)
    cells = F.array(*[F.struct(F.lit(i).alias("x"), F.col(c).cast("string").alias("content")) for i, c in enumerate(columns)])
    out = rows.select(F.col(key).alias("doc_id"), F.col("__y").alias("y"), F.explode(cells).alias("c")).select("doc_id", "y", "c.x", "c.content")
    return as_cells(out.where("content <> ''"))
