"""From a grammar and cells to matches: classification, then the waves of patterns, each a DataFrame over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.areas import above_threshold, area_matches, in_regions, settled
from gridloom.operators.arrays import array_matches
from gridloom.operators.classify import CHILDREN, cell_matches, terminal_matches
from gridloom.operators.overlap import resolved
from gridloom.plans.grammar import Grammar, Pattern
from gridloom.staging import staged

ISSUES = "doc_id string, severity string, code string, message string, pattern_name string, wave_index int, expected string, actual string"
#: Stable codes of diagnostics.
COUNT_MISMATCH, LIMIT_APPLIED, OVERLAP_MODE, PARSE_EXCEPTION = "PATTERN_COUNT_MISMATCH", "MATCH_LIMIT_APPLIED", "OVERLAP_RESOLUTION_UNEXPECTED_MODE", "PARSE_EXCEPTION"


class Matched:
    """The matches of a run: by pattern, with all that extend it, and what went amiss."""

    def __init__(self, grammar: Grammar, spark: SparkSession, doc_type: str) -> None:
        self.grammar, self.spark, self.doc_type = grammar, spark, doc_type
        self.own: dict[str, DataFrame] = {}
        self.wave: dict[str, int] = {}
        self.order = {n: i for i, n in enumerate(n for w in grammar.waves() for n in w)}
        self.documents: DataFrame | None = None
        self._issues: list[DataFrame] = []

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"doc_id {self.doc_type}, match_id string, ord long, l int, t int, r int, b int, precision double, content string, children {CHILDREN}")

    def lookup(self, name: str) -> DataFrame:
        """Matches of a pattern and of its extensions, with ``pord`` (the pattern's place), overlaps settled as the pattern says."""
        out = None
        for n in [name, *self.grammar.extensions(name)]:
            if n in self.own:
                part = self.own[n].withColumn("pord", F.lit(self.order[n])).withColumn("pattern", F.lit(n))
                out = part if out is None else out.unionByName(part)
        if out is None:
            out = self._empty().withColumn("pord", F.lit(0)).withColumn("pattern", F.lit(name))
        return resolved(out, self.grammar.patterns[name].overlap)

    def first(self, name: str, limit: int) -> DataFrame:
        """The first matches of each document, in the order of registration, before overlaps are settled."""
        w = Window.partitionBy("doc_id").orderBy("pord", "ord", "match_id")
        return self.lookup(name).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")

    def roots(self) -> DataFrame:
        return self.lookup(self.grammar.root)

    def all(self) -> DataFrame:
        """Every match once, with its pattern and wave."""
        out = None
        for n, df in self.own.items():
            part = df.withColumn("pattern", F.lit(n)).withColumn("wave", F.lit(self.wave[n]))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self._empty().withColumn("pattern", F.lit("")).withColumn("wave", F.lit(0))

    def issues(self) -> DataFrame:
        out = self.spark.createDataFrame([], ISSUES)
        for df in self._issues:
            out = out.unionByName(df)
        return out

    def noted(self, p: Pattern, documents: DataFrame, code: str, message: str, expected: str, actual: Column, wave: int | None = None) -> None:
        """A warning of a pattern for each of the documents."""
        self._issues.append(
            documents.select(F.col("doc_id").cast("string"), F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(p.name).alias("pattern_name"), F.lit(wave).cast("int").alias("wave_index"), F.lit(expected).alias("expected"), actual.cast("string").alias("actual"))
        )

    def checked(self, p: Pattern, found: DataFrame, wave: int) -> DataFrame:
        """Counts of each document, of those without matches too, against count_in_document: a mismatch is noted, and what is beyond the upper limit left out."""
        span = p.count_in_document
        if span.start is None and span.stop is None:
            return found
        each = found.select("doc_id", F.lit(1).alias("n"))
        if self.documents is not None:
            each = each.unionByName(self.documents.select("doc_id", F.lit(0).alias("n")))
        counts = each.groupBy("doc_id").agg(F.sum("n").alias("n"))
        text = f"{'' if span.start is None else span.start}..{'' if span.stop is None else span.stop}"
        bad = F.lit(False)
        if span.start is not None:
            bad = bad | (F.col("n") < span.start)
        if span.stop is not None:
            bad = bad | (F.col("n") > span.stop)
        codes = [(COUNT_MISMATCH, bad)] + ([(LIMIT_APPLIED, F.col("n") > span.stop)] if span.stop is not None else [])
        for code, test in codes:
            self.noted(p, counts.where(test), code, f"count of {p.name} is not {text}", text, F.col("n"), wave)
        if span.stop is None:
            return found
        w = Window.partitionBy("doc_id").orderBy("ord", "match_id")
        return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= span.stop).drop("n")


def run(grammar: Grammar, cells: DataFrame, target: str | None = None, everything: bool = False, stage: bool = True, hook: Callable[[int, list[str], Matched], None] | None = None) -> Matched:
    """Matches a grammar against the cells of all documents at once.

    Patterns that neither the target nor the root needs are left out, unless ``everything`` is asked for;
    the wave that holds the root then matches the root alone. Each wave's matches are staged on shared
    storage, so later waves read them and lineage stays short. ``hook`` is called after each wave.
    """
    found = cell_matches(cells, grammar.effective_cell_types())
    found = staged(found.select("doc_id", "cell_id", "x", "y", "w", "h", "content", "cell_type", "confidence"), "types") if stage else found
    out = Matched(grammar, cells.sparkSession, dict(cells.dtypes)["doc_id"])
    # A document that couldn't be read is an error of its own, not one without matches.
    out.documents = (cells.where("error is null") if "error" in cells.columns else cells).select("doc_id").distinct()
    terminals = terminal_matches(grammar, found)
    live = set(grammar.patterns) if everything else grammar.live(target)
    keep = (lambda df, n: staged(df, "wave")) if stage else (lambda df, n: df)

    def dependent(name: str, asked: DataFrame) -> DataFrame:
        p = grammar.patterns[name]
        items = in_regions(out.lookup(p.item_pattern), asked)
        arrays = array_matches(items, p, ["doc_id", "sid"]).withColumn("pord", F.lit(out.order[name]))
        w = Window.partitionBy("doc_id", "sid").orderBy("ord", "match_id")
        # Read by the search for the area and again for those that it is made of.
        one = keep(arrays.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n"), "asked")
        used.setdefault(name, []).append(one.drop("sid", "pord"))
        return one

    used: dict[str, list[DataFrame]] = {}

    def register(name: str, parts: list[DataFrame], areas: DataFrame, wave: int) -> None:
        """Adds those matches of a pattern searched in context that the areas are made of, each once."""
        named = areas.select("doc_id", F.explode("children.child").alias("match_id")).distinct()
        for part in parts:
            rows = part.join(named, ["doc_id", "match_id"], "left_semi").select(out._empty().columns)
            out.own[name] = out.own[name].unionByName(rows) if name in out.own else rows
        out.own[name] = keep(out.own[name].dropDuplicates(["doc_id", "match_id"]), name)
        out.wave.setdefault(name, wave)

    for p in grammar.patterns.values():
        if p.name in live and p.overlap.unknown is not None:
            out.noted(p, out.documents, OVERLAP_MODE, f"overlap mode of {p.name} is not known", "none|full|partial", F.lit(p.overlap.unknown))
    for i, names in enumerate(grammar.waves()):
        if not everything and grammar.root in names:
            names = [grammar.root]
        for n in names:
            p = grammar.patterns[n]
            if n not in live or p.kind == "general" or p.dependent:
                continue
            if p.kind == "cell":
                rows = terminals[n]
            elif p.kind == "array":
                rows = array_matches(out.lookup(p.item_pattern), p)
            else:
                rows = area_matches(grammar, p, out.lookup, dependent, (lambda df: staged(df, "partial")) if stage else (lambda df: df))
                rows = above_threshold(rows)
                rows = rows if p.allows_overlapping else settled(staged(rows, "areas") if stage else rows)
            out.own[n] = keep(out.checked(p, rows, i), n) if p.kind != "cell" else out.checked(p, rows, i)
            out.wave[n] = i
            for name, parts in used.items():
                register(name, parts, out.own[n], i)
            used.clear()
        if hook:
            hook(i, list(names), out)
    return out
