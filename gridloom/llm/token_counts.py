"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import bpe
from gridloom.llm.store import freeing

_encodings: dict[tuple[str, str], object] = {}

#: Lengths a block of the suffix sums holds; a block is the most that one task sorts.
BLOCK = 4096
#: A run of white space of this length or more is encoded by the segment tree, as the library's matcher recurses over such a run.
RUN = 16_384
LONG_RUN = re.compile(rf"\s{{{RUN}}}")


def rank_encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once a process."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def encoded_length(text: str | None, path: str, pattern: str) -> int:
    """The number of ids of one whole text, null as empty; the same by either encoder."""
    if not text:
        return 0
    if len(text) >= RUN and LONG_RUN.search(text):
        return len(next(bpe.model(path, pattern).encode_batch([text])))
    return len(rank_encoding(path, pattern).encode_ordinary(text))


def encoded_lengths(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """(n_tokens): the encoded length of every whole text, one row a row; null counts as empty, length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [encoded_length(t.as_py(), path, pattern) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return df.select(F.col(text).alias("text")).mapInArrow(freeing(run), "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row for each length that occurs; null lengths are left out."""
    return lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """Suffix sums of a length histogram: a row for each length that occurs, longest first summed.

    Columns: n_tokens, n_docs, docs_at_least and tokens_at_least (documents of this length or more, and
    their tokens), total_docs, total_tokens, docs_below, and truncated_tokens: the corpus's tokens when
    each document is cut to n_tokens. Between two listed lengths a < L < b the values follow exactly from
    b's row: truncated(L) = total - tokens_at_least(b) + L * docs_at_least(b). Sums run inside blocks of
    BLOCK lengths; the sums of whole blocks are added from a table with one row a block. An empty
    histogram gives no rows.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    per = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block"))
    whole = Window.partitionBy()
    # One row a block of lengths: the longest text's length over BLOCK bounds these rows.
    sums = per.select(
        "block",
        (F.sum("d").over(later) - F.col("d")).alias("d_after"),
        (F.sum("t").over(later) - F.col("t")).alias("t_after"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.join(sums, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("d_after")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_after")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    return out.select(
        "*",
        (F.col("total_docs") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row (limit, tokens): the corpus's tokens when each document is cut to ``limit``; 0 for an empty corpus."""
    longer = F.col("n_tokens") >= limit
    b = F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(longer, F.col("n_tokens")))
    return table.agg(
        F.lit(limit).cast("bigint").alias("limit"),
        F.coalesce(F.max("total_tokens") - F.coalesce(b["tokens_at_least"], F.lit(0)) + limit * F.coalesce(b["docs_at_least"], F.lit(0)), F.lit(0)).alias("tokens"),
    )


def length_quantile(table: DataFrame, q: float) -> DataFrame:
    """One row (q, n_tokens): the smallest length that at least a share ``q`` of documents doesn't exceed; null if there are none."""
    upto = F.col("docs_below") + F.col("n_docs")
    return table.where(upto >= F.lit(q) * F.col("total_docs")).agg(F.lit(q).alias("q"), F.min("n_tokens").alias("n_tokens"))
