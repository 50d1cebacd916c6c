"""Matches of one pattern that lie over one another: the better one by the pattern's criteria stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.grammar import Overlap


def _rank(overlap: Overlap, side: str) -> Column:
    """A struct that compares as the criteria do, greater being better."""
    c = lambda n: F.col(f"{side}.{n}")
    values = {"area": (c("r") - c("l")) * (c("b") - c("t")), "width": c("r") - c("l"), "height": c("b") - c("t"), "precision": c("precision")}
    return F.struct(*[(values[m].cast("double") * sign).alias(f"k{i}") for i, (m, sign) in enumerate(overlap.criteria)])


def without_full(matches: DataFrame, overlap: Overlap) -> DataFrame:
    """Of matches with the same top left corner, one inside the other, the worse goes; equal ones both stay.

    Nesting with a common corner is a chain in both dimensions, and losing is judged against any better
    match that was there, so the outcome doesn't hang on the order of comparisons.
    """
    a, b = matches.alias("a"), matches.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.l") == F.col("b.l")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.match_id") != F.col("b.match_id"))
    nested = ((F.col("a.r") <= F.col("b.r")) & (F.col("a.b") <= F.col("b.b"))) | ((F.col("a.r") >= F.col("b.r")) & (F.col("a.b") >= F.col("b.b")))
    return a.join(b, on & nested & (_rank(overlap, "a") < _rank(overlap, "b")), "left_anti")


def without_partial(matches: DataFrame, overlap: Overlap) -> DataFrame:
    """After full overlaps, of two matches that share a corresponding corner and aren't nested the worse goes."""
    left = without_full(matches, overlap)
    lost = None
    for x, y in (("l", "t"), ("r", "t"), ("r", "b"), ("l", "b")):
        a, b = left.alias("a"), left.alias("b")
        on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col(f"a.{x}") == F.col(f"b.{x}")) & (F.col(f"a.{y}") == F.col(f"b.{y}")) & (F.col("a.match_id") != F.col("b.match_id"))
        inside = lambda p, q: (F.col(f"{p}.l") >= F.col(f"{q}.l")) & (F.col(f"{p}.t") >= F.col(f"{q}.t")) & (F.col(f"{p}.r") <= F.col(f"{q}.r")) & (F.col(f"{p}.b") <= F.col(f"{q}.b"))
        worse = a.join(b, on & ~inside("a", "b") & ~inside("b", "a") & (_rank(overlap, "a") < _rank(overlap, "b"))).select("a.doc_id", "a.match_id")
        lost = worse if lost is None else lost.union(worse)
    return left.join(lost.distinct(), ["doc_id", "match_id"], "left_anti")


def resolved(matches: DataFrame, overlap: Overlap) -> DataFrame:
    """By the pattern's mode: none, full or partial."""
    return {"none": lambda: matches, "full": lambda: without_full(matches, overlap), "partial": lambda: without_partial(matches, overlap)}[overlap.mode]()
