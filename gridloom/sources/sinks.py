"""Sinks: JSON lines of documents, waves and reports, and lists of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import schedule


def write_json_text(df: DataFrame, path: str, column: str = "json") -> None:
    """One JSON text a line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_waves(matches: DataFrame, path: str, waves: list[int] | None = None) -> None:
    """Matches as JSON below wave=.../, each once; only the given waves, if any are given."""
    some = matches.dropDuplicates(["doc_id", "match_id"])
    if waves is not None:
        some = some.where(F.col("wave").isin(waves))
    some.write.mode("overwrite").partitionBy("wave").json(path)


def write_tree(matches: DataFrame, path: str) -> None:
    """Matches and the edges to their children as two Parquet tables."""
    matches.drop("children").write.mode("overwrite").parquet(f"{path}/matches")
    edges = matches.select("doc_id", F.col("match_id").alias("parent_id"), F.posexplode("children").alias("ord", "c"))
    edges.select("doc_id", "parent_id", "c.name", "ord", F.col("c.child").alias("child_id"), "c.inner").write.mode("overwrite").parquet(f"{path}/match_edges")


def write_values(df: DataFrame, path: str) -> None:
    """A list of values, one a line, in one file; meant for small lists."""
    df.coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark, path: str) -> DataFrame:
    """(path, original_title): of exported documents below a path."""
    files = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema("title struct<original_title:string>").json(path)
    return files.select(F.input_file_name().alias("path"), "title.original_title")


def rebuild_metadata(spark, path: str, target: str) -> None:
    """Reads the exported documents below a path and writes the metadata that follow from each one's path and title, one JSON a line."""
    found = read_metadata(spark, path).select("path", schedule.schedule_metadata(F.col("path"), F.col("original_title")).alias("metadata"))
    found.select("path", "metadata.*").orderBy("path").write.mode("overwrite").json(target)
