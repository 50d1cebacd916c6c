"""What a run leaves to look at: unused matches, the best match of each cell, annotations, diagnostics, JSON."""

from __future__ import annotations

import colorsys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import joined_letters
from gridloom.operators.classify import json_text
from gridloom.operators.grid import points
from gridloom.staging import staged

PALETTE = 11


def _levels(matches: DataFrame, roots: DataFrame, depth: int) -> list[DataFrame]:
    """(doc_id, match_id) by level: the roots, what they are made of, and so on while there is anything, down to ``depth``.

    Deeper walks stage each level, so that the next one reads a table instead of repeating the walk.
    """
    keep = (lambda df: staged(df, "level")) if depth > 1 else (lambda df: df)
    edges = matches.select("doc_id", "match_id", F.explode("children.child").alias("child"))
    out = [keep(roots.select("doc_id", "match_id").distinct())]
    for _ in range(depth):
        level = keep(out[-1].join(edges, ["doc_id", "match_id"]).select("doc_id", F.col("child").alias("match_id")).distinct())
        if depth > 1 and level.isEmpty():
            break
        out.append(level)
    return out


def _all_levels(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, levels).distinct()


def reachable(matches: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(doc_id, match_id): the roots and all they are made of, down to ``depth`` levels (the number of waves bounds it)."""
    return _all_levels(_levels(matches, roots, depth))


def unused(matches: DataFrame, roots: DataFrame, depth: int, patterns: list[str] | None = None) -> DataFrame:
    """Matches (of the given patterns) that no root is made of."""
    some = matches.where(F.col("pattern").isin(patterns)) if patterns else matches
    return some.join(reachable(matches, roots, depth), ["doc_id", "match_id"], "left_anti")


def counts(matches: DataFrame) -> DataFrame:
    """(doc_id, wave, pattern, n)."""
    return matches.groupBy("doc_id", "wave", "pattern").agg(F.count(F.lit(1)).alias("n"))


def best_per_cell(matches: DataFrame) -> DataFrame:
    """For each point the match of greatest precision that covers it; the earliest of equal ones."""
    w = Window.partitionBy("doc_id", "px", "py").orderBy(F.desc("precision"), "ord", "match_id")
    return points(matches).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def colours(patterns: DataFrame) -> DataFrame:
    """(doc_id, pattern, colour): numbers below PALETTE, given in the order of each pattern's first match."""
    first = patterns.groupBy("doc_id", "pattern").agg(F.min("ord").alias("ord"))
    return first.select("doc_id", "pattern", ((F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "pattern")) - 1) % PALETTE).alias("colour"))


def annotations(matches: DataFrame) -> DataFrame:
    """(doc_id, l, t, note): for each place the matches that begin there, largest first, as ``name: WxH, precision``."""
    text = F.format_string("%s: %dx%d, %.2f", "pattern", F.col("r") - F.col("l"), F.col("b") - F.col("t"), "precision")
    area = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    rows = F.array_sort(F.collect_list(F.struct((-area).alias("a"), (-F.col("precision")).alias("p"), text.alias("text"))))
    return matches.groupBy("doc_id", "l", "t").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("note"))


def painted(matches: DataFrame) -> DataFrame:
    """(doc_id, x, y, colour, note): points in the colour of their best match's pattern, with the notes of what begins there."""
    shades = F.array(*[F.lit("".join(f"{round(v * 255):02X}" for v in colorsys.hls_to_rgb(i / PALETTE, 0.8, 0.6))) for i in range(PALETTE)])
    best = best_per_cell(matches).join(colours(matches), ["doc_id", "pattern"]).select("doc_id", F.col("px").alias("x"), F.col("py").alias("y"), F.get(shades, F.col("colour")).alias("colour"))
    return best.join(annotations(matches).select("doc_id", F.col("l").alias("x"), F.col("t").alias("y"), "note"), ["doc_id", "x", "y"], "full")


def confidence_colours(found: DataFrame, share: float = 0.4) -> DataFrame:
    """(doc_id, cell_id, colour, note): red up to 0.5, green from 0.85, else amber, by the best type; types of at least that share of it are listed."""
    best = found.groupBy("doc_id", "cell_id").agg(F.max("precision").alias("best"), F.array_sort(F.collect_list(F.struct((-F.col("precision")).alias("p"), "cell_type"))).alias("types"))
    listed = F.transform(F.filter("types", lambda x: -x["p"] >= F.col("best") * share), lambda x: F.format_string("%s: %.2f", x["cell_type"], -x["p"]))
    return best.select("doc_id", "cell_id", F.when(F.col("best") <= 0.5, "red").when(F.col("best") >= 0.85, "green").otherwise("amber").alias("colour"), F.array_join(listed, "\n").alias("note"))


def box_fields(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return F.struct(c("l").alias("left"), c("t").alias("top"), c("r").alias("right"), c("b").alias("bottom"), (c("r") - c("l")).alias("width"), (c("b") - c("t")).alias("height"))


def serialised(matches: DataFrame) -> DataFrame:
    """(doc_id, match_id, json): each match with its components, one level deep."""
    parts = matches.select("doc_id", "match_id", F.posexplode("children").alias("i", "c"))
    boxes = matches.select("doc_id", F.col("match_id").alias("child"), F.col("pattern").alias("child_pattern"), box_fields().alias("child_box"))
    joined = parts.select("doc_id", "match_id", "i", "c.name", "c.child").join(boxes, ["doc_id", "child"])
    components = joined.groupBy("doc_id", "match_id").agg(F.array_sort(F.collect_list(F.struct("i", "name", F.col("child_pattern").alias("pattern"), F.col("child_box").alias("box")))).alias("parts"))
    shaped = F.transform(F.coalesce("parts", F.array().cast(components.schema["parts"].dataType)), lambda x: F.struct(x["name"].alias("name"), x["pattern"].alias("pattern"), x["box"].alias("box")))
    out = matches.join(components, ["doc_id", "match_id"], "left")
    return out.select("doc_id", "match_id", F.to_json(F.struct("pattern", "precision", box_fields().alias("box"), "content", F.size(shaped).alias("component_count"), shaped.alias("components"))).alias("json"))


def summaries(matches: DataFrame, among: DataFrame, *by: str) -> DataFrame:
    """(by, json): the matches of a document, or of a wave of it, as one JSON text with the number of each pattern's; ``among`` holds their components."""
    shown = serialised(among).join(matches.select("doc_id", "match_id", "ord", *[b for b in by if b != "doc_id"]), ["doc_id", "match_id"])
    listed = shown.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "match_id", "json"))), lambda m: m["json"]), ",").alias("list"))
    tally = matches.groupBy(*by, "pattern").agg(F.count(F.lit(1)).alias("n")).groupBy(*by)
    tally = tally.agg(F.sum("n").alias("total"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", "n"))))).alias("counts"))
    text = F.format_string('{"total":%d,"pattern_counts":%s,"matches":[%s]}', "total", "counts", "list")
    return listed.join(tally, list(by)).select(*by, text.alias("json"))


def trees(matches: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(doc_id, match_id, json): each root with all it is made of, down to ``depth`` levels below it, nested.

    The levels are joined from the deepest up, so that a match is shaped once however often it is used.
    """
    levels = _levels(matches, roots, depth)
    keep = (lambda df, n: staged(df, n)) if len(levels) > 2 else (lambda df, n: df)
    live = keep(matches.join(_all_levels(levels), ["doc_id", "match_id"], "left_semi"), "live")
    edges = live.select("doc_id", "match_id", F.posexplode("children").alias("i", "c")).select("doc_id", "match_id", "i", "c.name", "c.child")
    own = live.select("doc_id", "match_id", F.to_json(F.struct("pattern", "precision", box_fields().alias("box"), "content")).alias("head"))
    shaped = own.select("doc_id", "match_id", F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"components":[]}')).alias("json"))
    for _ in levels[1:]:
        below = edges.join(shaped.withColumnRenamed("match_id", "child"), ["doc_id", "child"])
        part = F.concat(F.lit('{"name":'), json_text(F.col("name")), F.lit(',"match":'), F.col("json"), F.lit("}"))
        parts = below.groupBy("doc_id", "match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("part")))), lambda x: x["part"]), ",").alias("parts"))
        text = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"components":['), F.coalesce("parts", F.lit("")), F.lit("]}"))
        shaped = keep(own.join(parts, ["doc_id", "match_id"], "left").select("doc_id", "match_id", text.alias("json")), "shaped")
    return shaped.join(roots.select("doc_id", "match_id"), ["doc_id", "match_id"], "left_semi")


def positioned(matches: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Matches whose content says where it stands: ``@box`` beside an area's parts, an array's ``@items`` or a cell's ``content``.

    ``kinds`` gives each pattern's kind, for patterns that have no match too; static data and their ``@content`` stay as they are.
    """
    place = F.concat(F.lit('{"@box":'), F.to_json(box_fields()))
    named = lambda name: F.concat(place, F.lit(f',"{name}":'), F.col("content"), F.lit("}"))
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("pattern")]
    inner = F.concat(place, F.when(F.col("content") == "{}", "").otherwise(","), F.substr("content", F.lit(2)))
    shaped = F.when(F.col("content").startswith("{"), inner).when(kind.startswith("array"), named("@items")).otherwise(named("content"))
    return matches.withColumn("content", shaped)


def text_content(texts: Column) -> Column:
    """Texts of a match with single characters joined."""
    return joined_letters(texts)


def diagnostics(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, json): for each document its summary by severity and its issues; documents without issues too."""
    severities = ("error", "warning", "info")
    listed = F.array_sort(F.collect_list(F.struct(*[c for c in issues.columns if c != "doc_id"]))).alias("issues")
    per = issues.groupBy("doc_id").agg(listed, *[F.count_if(F.col("severity") == s).alias(s + "s") for s in severities])
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(per, "doc_id", "left")
    summary = F.struct(*[F.coalesce(s + "s", F.lit(0)).alias(s + "s") for s in severities])
    none = F.array().cast(per.schema["issues"].dataType)
    return out.select("doc_id", F.to_json(F.struct(F.struct("doc_id").alias("document"), summary.alias("summary"), F.coalesce("issues", none).alias("issues"))).alias("json"))


def near_best(matches: DataFrame, *keys: str, ratio: float = 0.9) -> DataFrame:
    """The matches of each group whose precision is at least ``ratio`` of the group's best."""
    best = F.max("precision").over(Window.partitionBy(*keys))
    return matches.withColumn("__best", best).where(F.col("precision") >= F.col("__best") * ratio).drop("__best")
