"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, maglev, ngram_join, pstable, pu_quality, secret_scan, token_counts, token_store, warc
from gridloom.llm.store import new_path, written

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_ID = 1
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return found.select("doc_id", "kind", "candidate", "start", "score", "is_secret")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", WORD_TOKENIZER, END_ID)
    return token_store.read_tokens(manifest, digests=True).withColumnRenamed("id", "doc_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_RANKS, public_tokenizers.PATTERN)


def op4_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(_table(spark, sf_dir, "documents"), "text", BYTE_RANKS, public_tokenizers.PATTERN)
    return token_counts.context_table(written(token_counts.length_histogram(lengths), "histogram"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pu_quality.classify(docs, "doc_id", "text", _table(spark, sf_dir, "labels"), "doc_id", "quality", threshold=0.3)
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = new_path(spark, "shards")
    maglev.write_shards(docs, "doc_id", SHARDS, path)
    rows = spark.read.parquet(path)
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"), "slot", F.col("shard").cast("string").alias("shard"))


def _op10_sql() -> str:
    table = ",".join(map(str, maglev.lookup_table(SHARDS)))
    return f"""
WITH slots AS (SELECT unnest(range({maglev.SLOTS})) AS slot, unnest([{table}]) AS place),
d AS (SELECT *, coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {maglev.SLOTS}, 0) AS slot FROM documents)
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, slot, 'shard-' || lpad(CAST(place AS VARCHAR), 3, '0') AS shard FROM d JOIN slots USING (slot)
"""


REACH = """
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
part AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
"""

OP4_SQL = f"""
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.9),
{REACH},
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(part.b, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(part.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN part ON e.vec_id = part.a
"""

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
      FROM w WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
sim AS (SELECT a, b, both_.n / (p.n + q.n - both_.n) AS s FROM both_ JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id),
link AS (SELECT a, b FROM sim WHERE s >= 0.8),
same AS (SELECT a, min(b) AS b FROM sim WHERE s = 1 GROUP BY a),
{REACH},
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(same.b, d.doc_id)) AS class_id, coalesce(n.n, 0) AS n_links,
       least(d.doc_id, coalesce(part.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(part.b, d.doc_id) AS kept
FROM documents d LEFT JOIN same ON d.doc_id = same.a LEFT JOIN n ON d.doc_id = n.a LEFT JOIN part ON d.doc_id = part.a
"""

OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN k.keep <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keep <> d.page_id THEN k.keep END AS refers_to
FROM d LEFT JOIN k USING (payload_digest, payload_bytes)
"""

OP8_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
g AS (SELECT doc_id, k, len(w) AS size, [array_to_string(w[i:i+k-1], ' ') FOR i IN range(1, len(w) - k + 2)] AS g FROM w, k WHERE len(w) >= k),
ig AS (SELECT item_id, k, len(w) AS n, [array_to_string(w[i:i+k-1], ' ') FOR i IN range(1, len(w) - k + 2)] AS g FROM iw, k WHERE k = least(5, len(w))),
hit AS (SELECT doc_id, k, size, unnest(g) AS h, unnest(range(len(g))) AS p FROM g),
near AS (SELECT DISTINCT doc_id, k, size, item_id, n, p FROM hit JOIN (SELECT DISTINCT item_id, k, n, unnest(g) AS h FROM ig) USING (k, h)),
win AS (SELECT DISTINCT doc_id, item_id, k, n, unnest(range(greatest(0, p - least(n, size) + k), least(p, greatest(0, size - n)) + 1)) AS start FROM near),
wg AS (SELECT doc_id, item_id, start, n, len(x) AS size, unnest(x) AS h FROM (SELECT doc_id, item_id, start, n, g[start + 1 : start + n - k + 1] AS x FROM win JOIN g USING (doc_id, k))),
wc AS (SELECT doc_id, item_id, start, n, size, h, count(*) AS c FROM wg GROUP BY ALL),
ic AS (SELECT item_id, size, h, count(*) AS c FROM (SELECT item_id, len(g) AS size, unnest(g) AS h FROM ig) GROUP BY ALL),
sim AS (SELECT doc_id, start, n, item_id, sum(least(wc.c, ic.c)) / (wc.size + ic.size - sum(least(wc.c, ic.c))) AS similarity
        FROM wc JOIN ic USING (item_id, h) GROUP BY doc_id, start, n, item_id, wc.size, ic.size)
SELECT doc_id, item_id, similarity, start AS start_word, n AS n_words FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_token_output": op2_token_output,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_embedding_near_dup": op4_embedding_near_dup,
        "op5_token_counts": op5_token_counts,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_warc": op7_warc,
        "op8_decontamination": op8_decontamination,
        "op9_quality": op9_quality,
        "op10_sharding": op10_sharding,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_near_dup": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_warc": OP7_SQL, "op8_decontamination": OP8_SQL, "op10_sharding": _op10_sql()}
