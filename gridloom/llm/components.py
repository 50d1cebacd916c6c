"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.blocks import join_hot
from gridloom.llm.store import dropped, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Joins each node's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select("u", "size", F.least("u", "m").alias("m"))
    return join_hot(both, low, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them."""
    low = _least(edges)
    rest = join_hot(edges, low, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge with the smallest node it reaches.

    Null ends and loops are no edges; repeated edges count once; no edges give an empty result. A node of
    many edges is a hot key, whose edges stay where they are. Each step is written to the shared folder,
    so lineage stays short; nothing but two sums comes to the driver.
    """
    now = written(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        between = written(_large(now, before[0]), "edges")
        after = written(_small(between, between.count()), "edges")
        dropped(now)
        dropped(between)
        now, last, before = after, before, mark(after)
        if before == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component")).distinct()
