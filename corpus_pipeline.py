"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before kept.

The last stage returns digests of the encoding; the others return the columns of ``documents``, extra ones
left out. Stages that look documents up do so by doc_id where every row has one of its own; else by a row
number that follows the ids (null ids last), so that rows without an id and rows that repeat one are judged
by their own texts. A null text is empty: it is scored like an empty one, is no copy, holds nothing and has
no ids. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, ngram_join, pu_quality, secret_scan
from gridloom.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "__row"


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart."""
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs.select(*COLUMNS), "doc_id"
    return written(docs.select(*COLUMNS).orderBy(F.col("doc_id").asc_nulls_last()).withColumn(ROW, F.monotonically_increasing_id()), "rows"), ROW


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the quality classifier scores under 0.3. Labels are looked up by doc_id; without any all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.classify(docs.select(*COLUMNS), "doc_id", "text", labels, "doc_id", "quality", threshold=0.3).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the n-gram Jaccard join, the one of the smallest id; texts without words all stay."""
    rows, key = keyed(docs)
    return ngram_join.one_of_each(rows, key, "text").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold a benchmark item; without items all stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, key = keyed(docs)
    return decontaminate.decontaminated(rows, key, "text", items, "item_id", "text").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; n_chars follows the text, a null one's is null."""
    rows, key = keyed(docs)
    clean = secret_scan.redacted(rows, key, "text", "source")
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text that is left: (doc_id, n_tokens, ids_sha256, decoded_sha256), a row a document."""
    return bpe.round_trip_digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("byte_bpe", encoding),
]

#: No SQL: the first stage is a trained classifier and the last a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
