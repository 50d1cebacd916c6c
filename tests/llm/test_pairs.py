"""Near duplicates, contamination and components against brute force."""

import contextlib
import gc
import os
import random
import re
import threading
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from gridloom.llm import decontaminate, ngram_join, pstable
from gridloom.llm.components import connected_components

VOCAB = [f"w{i}" for i in range(300)]


def components(ids, links):
    label = {i: i for i in ids}
    for _ in range(len(label)):
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
        if not changed:
            break
    return label


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    ids = {x for e in edges for x in e if e[0] != e[1]}
    assert got == components(ids, edges)
    assert connected_components(df.limit(0), "a", "b").count() == 0


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    v = np.concatenate([base, base[:12] + 0.08 * rng.standard_normal((12, 16)), base[:3] * 2, np.repeat(base[:1], 40, 0), base[0] + 0.1 * rng.standard_normal((700, 16))])
    rows = [(i, [float(np.float32(x)) for x in r], "c") for i, r in enumerate(v)]
    return rows, [(9000, None, "c"), (9001, [], "c"), (9002, [0.0] * 16, "c"), (9003, [float("nan")] + [1.0] * 15, "c"), (9004, [1.0, None] + [0.0] * 14, "c"), (9005, [1.0] * 8, "c")]


def test_near_vectors(spark, monkeypatch):
    """The group of hundreds is larger than a block, so blocks meet in pairs of chunks."""
    monkeypatch.setattr(pstable, "BLOCK", 128)
    rows, odd = vectors()
    df = spark.createDataFrame(rows + odd, "vec_id long, v array<float>, kept string").repartition(5)
    got = {r.vec_id: r for r in pstable.near_vectors(df, "vec_id", "v").collect()}
    m = np.array([r[1] for r in rows])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if s[i, j] >= 0.9]
    degree = Counter(x for e in links for x in e)
    label = components(range(len(rows)), links)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found <= 2 * len(links) and found >= 0.999 * 2 * len(links)
    assert all(got[i].n_links <= degree[i] for i in range(len(rows)))
    assert {i: got[i].component_id for i in range(len(rows))} == label
    assert all(got[i].kept == (label[i] == i) for i in range(len(rows)))
    for i, _, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pstable.near_vectors(df.limit(0), "vec_id", "v").count() == 0


def test_near_vectors_disk(spark, monkeypatch, tmp_path):
    """What lies on disk at once is a few times the vectors, though each is sent for 30 tables."""
    from gridloom.llm import store

    monkeypatch.setattr(pstable, "ROUND", 0, raising=False)
    monkeypatch.setattr(store, "shared_dir", lambda _: str(tmp_path))
    rng = np.random.default_rng(6)
    v = rng.standard_normal((30_000, 64)).astype(np.float32)
    v[1::3] = v[::3] + 0.2 * v[1::3]
    path = f"{tmp_path}-in"
    pq.write_table(pa.table({"k": np.arange(len(v)), "v": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float32()))}), path)
    folders = [str(tmp_path), *(str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]
    over, seen = threading.Event(), [0]

    def used():
        files = (os.path.join(d, x) for f in folders for d, _, names in os.walk(f) for x in names)
        return sum(os.path.getsize(x) for x in files if os.path.exists(x))

    def watch():
        while not over.wait(0.1):
            with contextlib.suppress(OSError):
                seen.append(used())

    for _ in range(2):  # what other tests left
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)
    before = used()
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = pstable.near_vectors(spark.read.parquet(path), "k", "v").agg({"n_links": "sum"}).first()[0]
    finally:
        over.set()
        watcher.join()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = 2 * int((np.einsum("ij,ij->i", u[::3], u[1::3]) >= 0.9).sum())
    assert 0.999 * want <= got <= want
    assert max(seen) - before < 5 * v.nbytes


def test_projections_follow_the_table():
    few, many = (pstable.projections_for(n, 0.9) for n in (10_000, 10_000_000))
    assert few == pstable.PROJECTIONS < many and pstable.tables_for(0.9, k=many) > pstable.tables_for(0.9, k=few) == 30


def test_near_vectors_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (3, [5.0, -9.0])], "k long, v array<double>")
    got = sorted(((r.k or 0, r.n_links, r.component_id or 0, r.kept) for r in pstable.near_vectors(df, "k", "v").collect()))
    assert got == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 0, 2, False), (3, 1, 2, False)]


def test_parameters():
    assert pstable.tables_for(0.9) > pstable.tables_for(0.95) >= 1 and pstable.collision(0, 1) == 1
    assert ngram_join.bands_for(0.8) == (18, 4) and 1 - (1 - 0.8**4) ** 18 >= ngram_join.RECALL


def gram_set(t, n=5):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def texts():
    rng = random.Random(8)
    out = [" ".join(rng.choices(VOCAB, k=80)) for _ in range(30)]
    hub = rng.choices(VOCAB, k=90)
    for k in range(400):  # near copies of one text, more than a block
        w = list(hub)
        for _ in range(k % 4):
            w[rng.randrange(90)] = rng.choice(VOCAB)
        out.append(" ".join(w))
    out += [out[0], out[0].upper() + "!", out[1] + " tail", "one two", "One, two", "", None, "…", " ".join(hub[:45])]
    return out


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(6)
    got = {r.doc_id: r for r in ngram_join.jaccard_join(df, "doc_id", "text").collect()}
    sets = {i: gram_set(t) for i, t, _ in rows}
    sim = lambda a, b: len(a & b) / len(a | b) if a and b else 0
    pairs = {(i, j): sim(sets[i], sets[j]) for i, j in combinations(sets, 2)}
    links = [e for e, s in pairs.items() if s >= 0.8]
    degree = Counter(x for e in links for x in e)
    label = components(sets, links)
    found, all_ = sum(r.n_links for r in got.values()), 2 * len(links)
    assert 0.9995 * all_ <= found <= all_ and all(got[i].n_links <= degree[i] for i in sets)
    assert {i: r.component_id for i, r in got.items()} == label
    same = components(sets, [e for e, s in pairs.items() if s == 1])
    assert {i: r.class_id for i, r in got.items()} == same
    left = {r.doc_id for r in ngram_join.one_of_each(df, "doc_id", "text").collect()}
    assert left == {i for i in sets if label[i] == i}
    assert ngram_join.jaccard_join(df.limit(0), "doc_id", "text").count() == 0


def test_jaccard_join_odd_keys(spark):
    t = " ".join(VOCAB[:30])
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (6, t + " x"), (5, "another text of some other words")], "k long, t string")
    got = sorted((r.k or 0, r.n_links, r.component_id or 0) for r in ngram_join.jaccard_join(df, "k", "t").collect())
    assert got == [(0, 0, 0), (5, 0, 5), (5, 2, 5), (5, 2, 5), (6, 2, 5)]
    assert sorted(r.k or 0 for r in ngram_join.one_of_each(df, "k", "t").collect()) == [0, 5, 5, 5]


def bag(w, n=5):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def test_contaminations(spark):
    """Every window of an item's size at every place, by brute force."""
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(16, 40)))) for i in range(12)] + [(50, "w7 W8"), (51, None), (52, "the " * 20), (53, "w1 w2 w3 w4"), (54, " "), (55, "w9")]
    items.append((56, items[3][1]))
    docs = []
    for i in range(60):
        w = rng.choices(VOCAB, k=rng.randint(0, 120))
        if i % 3 == 0:
            p = items[i % 12][1].split()
            for _ in range(i % 4):
                p[rng.randrange(len(p))] = rng.choice(VOCAB)
            if i % 5 == 0:
                p.insert(len(p) // 2, "extra")
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() + "," for x in p] + w[at:]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (103, items[3][1].rsplit(" ", 2)[0]), (104, "the " * 300), (105, "a W7, w8; b w7 w8"), (None, items[0][1]), (102, items[4][1])]
    want = {}
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for k, x in items:
            iw = re.findall(r"[^\W_]+", (x or "").lower())
            if d is None or not iw:
                continue
            size = min(5, len(iw))
            b = bag(iw, size)
            for s in range(max(1, len(w) - len(iw) + 1)):
                a = bag(w[s : s + len(iw)], size)
                low = sum((a & b).values())
                sim = low / max(1, sum(a.values()) + sum(b.values()) - low)
                if sim >= 0.8:
                    want[d, k] = max(want.get((d, k), (0, 0)), (sim, -s))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "body")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start_word) for r in decontaminate.contaminations(df, "doc_id", "body", bench, "item_id", "text").collect()}
    assert {k for k in got if k[1] < 50} == {k for k in want if k[1] < 50} and (102, 4) in got and (103, 3) in got
    assert set(got) == set(want) and {k[1] for k in want} >= {50, 55, 56}
    # Rows that repeat a key have one best window; its place is one of theirs.
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    same = decontaminate.contaminations(df, "doc_id", "body", bench.withColumnRenamed("item_id", "doc_id"), "doc_id", "text")
    assert same.columns == ["doc_id", "item_doc_id", "similarity", "start_word", "n_words"] and same.count() == len(want)
    clean = decontaminate.decontaminated(df, "doc_id", "body", bench, "item_id", "text")
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in clean.collect()) == sorted(-1 if d is None else d for d, _ in docs if (d not in {x for x, _ in want}))
    assert decontaminate.contaminations(df.limit(0), "doc_id", "body", bench, "item_id", "text").count() == 0
    assert decontaminate.contaminations(df, "doc_id", "body", bench.limit(0), "item_id", "text").count() == 0


def test_contaminations_reordered(spark):
    """A passage in another order is held by a window that no shared shingle is aligned on."""
    rng = random.Random(5)
    w = [f"i{k}" for k in range(59)]
    fill = lambda k: rng.choices(VOCAB, k=k)
    docs = [
        (1, fill(40) + w[25:50] + w[:25] + fill(40)),
        (2, w[25:50] + w[:25] + fill(9)),
        (3, fill(70) + w[30:50] + w[:30]),
        (4, fill(12) + w[25:40] + fill(10) + w[:25] + fill(30)),
        (5, fill(30) + w[:49] + fill(30)),
        (5, fill(3) + w[:50]),
        (6, w[25:50] + w[:25]),
        (7, fill(8) + w[:45]),
    ]
    item = w[:50]
    want = {}
    for d, t in docs:
        for s in range(max(1, len(t) - 49)):
            a, b = bag(t[s : s + 50]), bag(item)
            low = sum((a & b).values())
            sim = low / (sum(a.values()) + sum(b.values()) - low)
            if sim >= 0.8:
                want[d] = max(want.get(d, 0), sim)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminations(df, "doc_id", "text", bench, "item_id", "text").collect()}
    assert {1, 2, 3, 6} <= set(want) and 4 not in want
    assert {d: round(r.similarity, 9) for d, r in got.items()} == {d: round(x, 9) for d, x in want.items()}
    assert got[1].start_word == 40 and got[5].start_word == 3


def test_index_finds_all_within_the_radius():
    """The pigeonhole: among eight blocks one differs in two bits at most."""
    rng = random.Random(3)
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS))
        size = 64 // decontaminate.BLOCKS
        assert min((x >> i * size & (1 << size) - 1).bit_count() for i in range(decontaminate.BLOCKS)) <= decontaminate.RADIUS // decontaminate.BLOCKS
