"""Token output, byte BPE, token counts and sharding against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe, maglev, token_counts, token_store

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
random.seed(5)
ODD = "abcDEF .,'!-_\n\t 12éßİ́KΣς中 \x85\x1c\xa0<|>"
TEXTS = [None, "", "x", "The end. The, end.", "don't it's", "İ.", "中文 text", "<|endoftext|> a", "word " * 3000, "a" * 5000, "line\nline\r\nline", "!!! ... ,,, x.. y,."]
TEXTS += ["".join(random.choice(ODD) for _ in range(random.randint(0, 40))) for _ in range(400)]


def docs(spark, rows=None):
    rows = rows if rows is not None else [(i * 3 % 1009, t, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def word_ids(t, special_as_text=False):
    tk = Tokenizer.from_file(WORDS)
    if special_as_text:
        tk.encode_special_tokens = True
    return tk.encode(t or "", add_special_tokens=False).ids


def test_token_store(spark):
    rows = [(i * 3 % 1009, t, "c") for i, t in enumerate(TEXTS)] + [(0, "twice", "c"), (None, "no key", "c")]
    manifest = token_store.write_tokens(docs(spark, rows), "doc_id", "text", WORDS, 1)
    got = sorted(token_store.read_tokens(manifest).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r.id for r in got] == [r[0] for r in order]
    left = [(r[0], tuple(word_ids(r[1]) + [1])) for r in order]
    for r in got:
        left.remove((r.id, tuple(r.ids)))  # rows of equal keys in any order
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens
    assert not left
    crc = {r.start: r.ids_crc32 for r in token_store.read_tokens(manifest, digests=True).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert token_store.read_document(manifest, 9) == word_ids(TEXTS[3]) + [1] and token_store.read_document(manifest, -5) is None


def test_special_tokens_of_texts(spark):
    """As the library does it by default, or as plain text."""
    texts = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "x <| y", "<|endoftext|><|endoftext|>.", "İ <|endoftext|>", "<|endoftext| >"]
    df = docs(spark, [(i, t, "c") for i, t in enumerate(texts)])
    for plain in (False, True):
        got = {r.id: r.ids for r in token_store.read_tokens(token_store.write_tokens(df, "doc_id", "text", WORDS, 1, special_as_text=plain)).collect()}
        assert got == {i: word_ids(t, plain) + [1] for i, t in enumerate(texts)}
    assert word_ids(texts[0]) == [49407]


def test_token_store_guards(spark, tmp_path):
    assert token_store.read_tokens(token_store.write_tokens(docs(spark, []), "doc_id", "text", WORDS, 1)).count() == 0
    manifest = token_store.write_tokens(docs(spark, [(1, "a b", "c")]), "doc_id", "text", WORDS, 1)
    path = manifest.first().path
    with pytest.raises(ValueError):
        token_store.Shard(path, b"another dictionary")


def test_byte_bpe(spark):
    enc = token_counts.rank_encoding(RANKS, P.PATTERN)
    model = bpe.SegmentTreeBpe(RANKS, P.PATTERN)
    assert [x.tolist() for x in model.encode_batch(TEXTS)] == [enc.encode_ordinary(t or "") for t in TEXTS]
    long = "".join(random.choice("abcdefgh") for _ in range(3000))
    assert next(model.encode_batch([long])).tolist() == enc.encode_ordinary(long)
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs(spark), "doc_id", "text", RANKS, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        r = got[i * 3 % 1009]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.encode(docs(spark), "doc_id", "text", RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(coded, "doc_id", "ids", RANKS, P.PATTERN).collect()}
    assert back == {i * 3 % 1009: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(docs(spark, []), "doc_id", "text", RANKS, P.PATTERN).count() == 0


def test_very_long_text_goes_in_steps(spark):
    enc, model = token_counts.rank_encoding(RANKS, P.PATTERN), bpe.model(RANKS, P.PATTERN)
    text = " ".join(str(i) for i in range(120_000))
    assert next(model.encode_batch([text])).tolist() == enc.encode_ordinary(text)


def test_token_counts(spark):
    enc = token_counts.rank_encoding(RANKS, P.PATTERN)
    n = [len(enc.encode_ordinary(t or "")) for t in TEXTS]
    table = token_counts.context_table(token_counts.length_histogram(token_counts.encoded_lengths(docs(spark), "text", RANKS, P.PATTERN))).cache()
    counts = Counter(n)
    for r in table.collect():
        k = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (counts.pop(k), sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert (r.total_docs, r.total_tokens, r.docs_below, r.truncated_tokens) == (len(n), sum(n), sum(x < k for x in n), sum(min(x, k) for x in n))
    assert not counts
    for limit in (0, 1, 7, 50, 10**9):
        assert token_counts.truncated_total(table, limit).first().tokens == sum(min(x, limit) for x in n)
    assert token_counts.length_quantile(table, 0.5).first().n_tokens == sorted(n)[(len(n) + 1) // 2 - 1]
    none = token_counts.context_table(token_counts.length_histogram(spark.createDataFrame([], "n_tokens long")))
    assert none.count() == 0 and token_counts.truncated_total(none, 5).first().tokens == 0


def test_long_blank_runs_are_counted(spark):
    """A run that is too long for the library's matcher; shorter ones agree with it."""
    enc = token_counts.rank_encoding(RANKS, P.PATTERN)
    texts = ["a" + " " * 20_000 + "b", "\n" * 30_000, " \t" * 9_000 + "end"]
    assert [token_counts.encoded_length(t, RANKS, P.PATTERN) for t in texts] == [len(enc.encode_ordinary(t)) for t in texts]
    huge = docs(spark, [(1, " " * 2_000_000, "c"), (2, "x" + " " * 2_000_000 + "y", "c")])
    n = sorted(r.n_tokens for r in token_counts.encoded_lengths(huge, "text", RANKS, P.PATTERN).collect())
    model = bpe.model(RANKS, P.PATTERN)
    assert n == sorted(len(next(model.encode_batch([t]))) for t in (" " * 2_000_000, "x" + " " * 2_000_000 + "y"))


def test_cache_has_a_bound(monkeypatch):
    enc = token_counts.rank_encoding(RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "CACHE", 2000)
    model = bpe.SegmentTreeBpe(RANKS, P.PATTERN)
    for k in range(30):
        text = " ".join(f"word{k}x{i}" for i in range(200))
        assert next(model.encode_batch([text])).tolist() == enc.encode_ordinary(text)
        assert model.held < 2000 + 10_000
    model.forget()
    assert not model.cache and not model.held


def test_lookup_table():
    """Against turns taken with explicit preference lists."""
    names = [f"s{i}" for i in range(7)]
    m, table = 101, [None] * 101
    lists = []
    for s in names:
        d = hashlib.sha256(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % m, int.from_bytes(d[8:16], "big") % (m - 1) + 1
        lists.append(iter([(a + j * b) % m for j in range(m)]))
    while None in table:
        for i, prefer in enumerate(lists):
            if None in table:
                table[next(k for k in prefer if table[k] is None)] = i
    assert maglev.lookup_table(names, m) == table
    shares = Counter(maglev.lookup_table([f"s{i}" for i in range(256)]))
    assert max(shares.values()) - min(shares.values()) <= 1
    a, b = maglev.lookup_table(names), maglev.lookup_table(names[:-1])
    moved = sum(x != y for x, y in zip(a, b)) / len(a)
    assert 1 / 7 <= moved < 0.25
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            maglev.lookup_table(bad)
    with pytest.raises(ValueError):
        maglev.lookup_table(["a"], 100)


def test_assign_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, None)], "doc_id long, shard string")
    names = ["a", "b", "c"]
    table = maglev.lookup_table(names)
    got = maglev.assign_shards(df, "doc_id", names).collect()
    for r in got:
        slot = 0 if r.doc_id is None else int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % maglev.SLOTS
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert len(got) == 4 and maglev.assign_shards(df.limit(0), "doc_id", names).count() == 0
    hot = docs(spark).union(docs(spark, [(7, "same", "c")] * 900))
    maglev.write_shards(hot, "doc_id", names, str(tmp_path / "out"), rows=200)
    out = spark.read.parquet(str(tmp_path / "out"))
    rows = [(r.doc_id, r.text, r.ids) for r in hot.collect()]
    assert Counter((r.doc_id, r.text, r.ids) for r in out.collect()) == Counter(rows)
    assert all(r.shard == names[table[r.slot]] and r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % maglev.SLOTS for r in out.collect())
    maglev.write_shards(hot.limit(0), "doc_id", names, str(tmp_path / "none"))
