"""Whole jobs: from a folder of workbooks to files of contents, reports and timetables in the same sub-folders of another."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import schedule
from gridloom.operators import export, reports
from gridloom.plans.engine import Matched
from gridloom.plans.grammar import Grammar
from gridloom.plans.service import DocumentParser
from gridloom.sources.files import write_files
from gridloom.sources.workbook import match_workbooks
from gridloom.sources.xlsx import xlsx_cells
from gridloom.staging import staged


def _stem(spark: SparkSession, source: str) -> Column:
    """A document's path below the source folder, without its ending."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    root = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return F.regexp_replace(F.when(F.col("doc_id").startswith(root + "/"), F.substr("doc_id", F.lit(len(root) + 2))).otherwise(F.element_at(F.split("doc_id", "/"), -1)), r"\.[^./]*$", "")


def children(matches: DataFrame, of: DataFrame, name: str | None = None) -> DataFrame:
    """The components of some matches by their name, or all: (doc_id, path, match_id, l, t, r, b, content).

    ``path`` tells the places from the start of the walk on, so it orders the components.
    """
    edges = matches.select("doc_id", "match_id", F.posexplode("children").alias("i", "c"))
    if name is not None:
        edges = edges.where(F.col("c.name") == name)
    step = of.select("doc_id", "match_id", "path").join(edges, ["doc_id", "match_id"]).select("doc_id", F.concat("path", F.array("i")).alias("path"), F.col("c.child").alias("match_id"))
    return step.join(matches.select("doc_id", "match_id", "l", "t", "r", "b", "content"), ["doc_id", "match_id"])


def _word(content: Column) -> Column:
    """A cell's text from its JSON, a list's texts joined."""
    return F.array_join(export.texts(F.coalesce(F.get_json_object(F.concat(F.lit("["), content, F.lit("]")), "$[0]"), F.lit(""))), "")


def timetables(matched: Matched, documents: DataFrame) -> DataFrame:
    """(doc_id, json): each document's first root as a timetable; ``documents`` has doc_id.

    The root holds a ``title`` and a ``table`` of ``groups``, ``grid`` (lessons) and ``datetime`` with
    ``weeks`` of ``_days``. Documents without a root have an empty timetable.
    """
    matches = staged(matched.all(), "all")
    first = Window.partitionBy("doc_id").orderBy("ord", "match_id")
    roots = matched.roots().withColumn("n", F.row_number().over(first)).where("n = 1").select("doc_id", "match_id", F.array().cast("array<int>").alias("path"))
    down = lambda start, *names: down(children(matches, start, names[0]), *names[1:]) if names else start
    table = staged(down(roots, "table"), "table")
    title = down(roots, "title").groupBy("doc_id").agg(F.min_by(_word(F.col("content")), "path").alias("original_title"))
    known = table.select("doc_id", F.from_json(F.get_json_object("content", "$.groups.groups"), "array<string>").alias("known_groups"))
    weeks = staged(children(matches, down(table, "datetime", "weeks")).withColumn("week", F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))), "weeks")
    border = weeks.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) > 1, F.min_by("b", "path")).alias("week1_bottom"))
    grid = children(matches, down(table, "grid")).select("doc_id", "content", "t", "b")
    found = grid.join(known, "doc_id", "left").join(border, "doc_id", "left").withColumn("years", F.lit(schedule.YEARS))
    days = staged(children(matches, children(matches, weeks, "_days")), "days")
    day_name = children(matches, days, "week_day").select("doc_id", F.expr("slice(path, 1, size(path) - 1)").alias("day"), _word(F.col("content")).alias("week_day"))
    dates = children(matches, children(matches, down(days, "month_days")))
    at = F.expr("slice(path, 1, size(path) - 1)")
    month = children(matches, dates, "month_name").select("doc_id", at.alias("path"), _word(F.col("content")).alias("month"))
    number = children(matches, dates, "month_day").select("doc_id", at.alias("path"), _word(F.col("content")).alias("month_day"))
    # The paths of weeks, days and dates begin with one another's, each of a length of its own.
    cut = lambda n: F.slice("path", F.lit(1), F.lit(n))
    placed = weeks.select("doc_id", "week", F.col("path").alias("week_path"))
    calendar = month.join(number, ["doc_id", "path"]).withColumn("week_path", cut(4)).withColumn("day", cut(6))
    calendar = calendar.join(placed, ["doc_id", "week_path"]).join(day_name, ["doc_id", "day"])
    calendar = calendar.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))).select("doc_id", "week", "week_day", "month", "month_day", "ord")
    titles = documents.select("doc_id").distinct().join(title, "doc_id", "left").withColumn("path", F.col("doc_id").cast("string"))
    return export.documents(titles, export.lessons(found), export.calendar(calendar))


def run_folder(spark: SparkSession, grammar: Grammar | str | Path | dict, source: str, target: str, extras: bool = False, timetable: bool = False) -> DataFrame:
    """Parses all workbooks below a folder; gives (doc_id, ok, error) for each of them.

    The content of each document's root is written to ``<target>/<sub-folder>/<name>.json``, what went
    amiss to ``.issues.json`` beside it. With ``extras`` come ``.tree.json``, ``.wave_NN.json``,
    ``.unused.json`` and ``.unused.xlsx``, with ``timetable`` the ``.timetable.json``. A file that can't
    be read, has no root or can't be written has its error; no document stops another.
    """
    parser = DocumentParser(grammar)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(source)
    files = raw.select(F.col("path").alias("doc_id"))
    cells = staged(xlsx_cells(raw), "cells")
    found = parser.parse(cells, everything=extras)
    stem = _stem(spark, source)

    def named(df: DataFrame, ending: str | Column, content: str = "json") -> DataFrame:
        return df.select("doc_id", F.concat(stem, ending if isinstance(ending, Column) else F.lit(ending)).alias("name"), F.col(content).cast("binary").alias("content"))

    out = named(parser.contents(found), ".json").unionByName(named(parser.diagnostics(found, files), ".issues.json"))
    if extras:
        every = staged(found.all(), "all")
        depth = len(parser.grammar.waves())
        unused = staged(reports.unused(every, found.roots(), depth), "unused")
        out = out.unionByName(named(reports.trees(every, found.roots(), depth), ".tree.json"))
        out = out.unionByName(named(reports.summaries(every, every, "doc_id", "wave"), F.format_string(".wave_%02d.json", "wave")))
        out = out.unionByName(named(reports.summaries(unused, every, "doc_id"), ".unused.json"))
        with_unused = cells.join(unused.select("doc_id").distinct(), "doc_id", "left_semi")
        out = out.unionByName(named(match_workbooks(with_unused, unused), ".unused.xlsx", "content"))
    if timetable:
        out = out.unionByName(named(timetables(found, files), ".timetable.json"))
    written = write_files(out, target).groupBy("name").agg(F.max("error").alias("failed"))
    unread = cells.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("unread"))
    rows = files.withColumn("name", F.concat(stem, F.lit(".json"))).join(written, "name", "left").join(unread, "doc_id", "left")
    rows = rows.join(parser.contents(found).select("doc_id", F.lit(True).alias("rooted")), "doc_id", "left")
    error = F.coalesce("unread", F.when(F.col("rooted").isNull(), "no root"), "failed")
    return staged(rows.select("doc_id", error.isNull().alias("ok"), error.alias("error")), "job")
