"""Parsing of documents as one call: grammar, cells, matches, JSON and diagnostics."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import reports
from gridloom.plans.engine import Matched, run
from gridloom.plans.grammar import Grammar, read_grammar


class DocumentParser:
    """Parses all documents of a cells table by one grammar.

    Rows with an error (files that could not be read) become diagnostics of code PARSE_EXCEPTION; their
    documents have no matches. Nothing one document holds stops another.
    """

    def __init__(self, grammar: Grammar | str | Path | dict) -> None:
        self.grammar = grammar if isinstance(grammar, Grammar) else read_grammar(grammar)

    def parse(self, cells: DataFrame, target: str | None = None, everything: bool = False) -> Matched:
        good = cells.where("error is null").drop("error") if "error" in cells.columns else cells
        out = run(self.grammar, good, target, everything)
        if "error" in cells.columns:
            empty = F.lit(None).cast("string")
            out._issues.append(
                cells.where("error is not null").select(F.col("doc_id").cast("string"), F.lit("error").alias("severity"), F.lit("PARSE_EXCEPTION").alias("code"), F.col("error").alias("message"), empty.alias("pattern_name"), F.lit(None).cast("int").alias("wave_index"), empty.alias("expected"), empty.alias("actual"))
            )
        return out

    def contents(self, matched: Matched) -> DataFrame:
        """(doc_id, json): the content of each document's first root match."""
        w = Window.partitionBy("doc_id").orderBy("ord", "match_id")
        return matched.roots().withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", F.col("content").alias("json"))

    def unused(self, matched: Matched, patterns: list[str] | None = None) -> DataFrame:
        return reports.unused(matched.all(), matched.roots(), len(self.grammar.waves()), patterns)

    def diagnostics(self, matched: Matched, cells: DataFrame) -> DataFrame:
        return reports.diagnostics(matched.issues(), cells)
