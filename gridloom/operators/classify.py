"""Classification of cells and the matches of cell patterns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.patterns import CellType, classify
from gridloom.plans.grammar import Grammar

LIMIT = 5
MATCH_COLUMNS = ["doc_id", "match_id", "ord", "l", "t", "r", "b", "precision", "content", "children"]
CHILDREN = "array<struct<name:string,child:string,inner:boolean>>"


def json_text(c):
    """A text as JSON."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def merged(content, fields):
    """A content (JSON) with fields put before its own: an object's own ones win, anything else goes to ``@content``.

    ``fields`` are pairs of a name and a column of JSON.
    """
    if not fields:
        return content
    own = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    entry = lambda k, v: F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), v)
    free = [F.when(F.array_contains(own, k), F.array().cast("array<string>")).otherwise(F.array(entry(k, v))) for k, v in fields]
    head, body = F.array_join(F.flatten(F.array(*free)), ","), F.substr(content, F.lit(2))
    joined = F.concat(F.lit("{"), head, F.when((head != "") & (content != "{}"), ",").otherwise(""), body)
    alone = F.concat(F.lit("{"), F.array_join(F.array(*[entry(k, v) for k, v in fields]), ","), F.lit(',"@content":'), content, F.lit("}"))
    return F.when(content.startswith("{"), joined).otherwise(alone)


def static_fields(static_data: dict) -> list:
    """A pattern's static data as fields of ``merged``."""
    return [(k, F.lit(json.dumps(v, ensure_ascii=False))) for k, v in static_data.items()]


def cell_matches(cells: DataFrame, types: list[CellType], limit: int | None = LIMIT) -> DataFrame:
    """A row for each of a cell's best types, with ``rank`` from 1. A null content matches nothing."""
    found = cells.withColumn("found", classify(F.col("content"), types, limit)).select("*", F.posexplode("found").alias("rank", "m")).drop("found")
    return found.select(*[c for c in found.columns if c not in ("rank", "m")], "m.*", (F.col("rank") + 1).alias("rank"))


def terminal_matches(grammar: Grammar, found: DataFrame) -> dict[str, DataFrame]:
    """The matches of each cell pattern: cells whose types hold its own; the precision is the alternative's confidence."""
    out = {}
    for p in grammar.patterns.values():
        if p.kind == "cell":
            rows = found.where((F.col("cell_type") == p.content_type) & (F.col("confidence") >= 0.3))
            out[p.name] = rows.select(
                "doc_id",
                F.concat(F.lit(p.name + "#"), F.col("cell_id").cast("string")).alias("match_id"),
                (F.shiftleft(F.col("y").cast("long"), 32) + F.col("x")).alias("ord"),
                F.col("x").alias("l"),
                F.col("y").alias("t"),
                (F.col("x") + F.col("w")).alias("r"),
                (F.col("y") + F.col("h")).alias("b"),
                (F.col("confidence") * p.confidence).alias("precision"),
                merged(json_text(F.col("content")), static_fields(p.static_data)).alias("content"),
                F.array().cast(CHILDREN).alias("children"),
            )
    return out


def type_statistics(found: DataFrame) -> DataFrame:
    """(cell_type, n, best): cells of each type, and those it is the first choice of."""
    return found.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 1).alias("best"))


def conflicts(found: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, n): pairs of types that cells have together with at least that precision each."""
    per = found.where(F.col("precision") >= least).groupBy("doc_id", "cell_id").agg(F.array_sort(F.collect_set("cell_type")).alias("types"))
    pairs = F.flatten(F.transform("types", lambda a: F.transform(F.filter("types", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def unmatched(cells: DataFrame, found: DataFrame) -> DataFrame:
    """The cells that no type matches."""
    return cells.join(found.select("doc_id", "cell_id"), ["doc_id", "cell_id"], "left_anti")
