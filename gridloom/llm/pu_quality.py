"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import freeing

#: The model is fitted on so many trusted and unlabelled documents at most, those of lowest hash; all are scored.
POSITIVES, UNLABELLED = 8_000, 16_000
SEED = 20240305
#: Characters or bytes of a text that are looked at together.
SLICE = 1 << 20
CLASSES = 12
EXTRA = 8
FEATURES = CLASSES * CLASSES + EXTRA


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 10, np.uint8)
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" ", 3), (b"\n\r\t\v\f", 4), (b".", 5), (b",;:", 6), (b"!?", 7), (b"-_'\"()", 8), (b"|", 9)):
        kinds[list(chars)] = kind
    kinds[128:] = 11
    return kinds


BYTE_CLASSES = _byte_classes()
BLANK, BREAK = re.compile(r"\s"), re.compile("\n")


def _slices(text: str, border: re.Pattern, size: int = SLICE) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut before a border; longer where none comes."""
    a = 0
    while a < len(text) or not a:
        m = border.search(text, a + size)
        b = m.start() if m else len(text)
        yield text[a:b]
        a = max(b + 1, 1)


def features(text: str | None) -> np.ndarray:
    """Features of a whole text: how often each pair of byte classes follows one another, and of words and lines. Null is empty.

    A long text is taken in slices, so that only its different words and lines are held beside it.
    """
    text = text or ""
    raw = text.encode()
    pairs = np.zeros(CLASSES * CLASSES)
    for a in range(0, len(raw) - 1, SLICE):
        k = BYTE_CLASSES[np.frombuffer(raw, np.uint8, min(SLICE + 1, len(raw) - a), a)].astype(np.int64)
        pairs += np.bincount(k[:-1] * CLASSES + k[1:], minlength=CLASSES * CLASSES)
    different, words, letters, longest = set(), 0, 0, 0
    for part in _slices(text, BLANK):
        some = part.split()
        sizes = list(map(len, some))
        different.update(some)
        words, letters, longest = words + len(some), letters + sum(sizes), max(longest, max(sizes, default=0))
    lines = text.count("\n") + 1
    unlike = set()
    for part in _slices(text, BREAK):
        unlike.update(part.split("\n"))
    extra = (
        np.log1p(len(raw)) / 10,
        len(different) / max(1, words),
        len(unlike) / lines,
        letters / max(1, words) / 10,
        np.log1p(lines) / 5,
        longest**0.5 / 10,
        sum(map(str.isupper, different)) / max(1, len(different)),
        sum(map(str.isalpha, different)) / max(1, len(different)),
    )
    return np.concatenate([np.sqrt(pairs / max(1, len(raw) - 1)), extra]).astype(np.float32)


@dataclass
class PuModel:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w + self.b) @ self.v + self.c

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, hidden: int, epochs: int, rate: float, seed: int) -> PuModel:
    """Adam on logistic loss. Without a prior, trusted rows against unlabelled ones; else the non-negative risk."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (p - mean) / scale, (u - mean) / scale
    theta = [rng.standard_normal((p.shape[1], hidden)) / np.sqrt(p.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, s, t = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0
    steps = max(1, len(u) // 512)
    for _ in range(epochs):
        pi, ui = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
        for a, b in zip(pi, ui):
            if not len(a) or not len(b):
                continue
            x = np.concatenate([p[a], u[b]])
            h = np.tanh(x @ theta[0] + theta[1])
            z = h @ theta[2] + theta[3][0]
            zp, zu = z[: len(a)], z[len(a) :]
            # Derivatives of the mean losses log(1 + exp(-z)) for label 1 and log(1 + exp(z)) for label 0.
            as_one, as_zero, u_zero = (_sigmoid(zp) - 1) / len(a), _sigmoid(zp) / len(a), _sigmoid(zu) / len(b)
            if prior is None:
                d = np.concatenate([as_one, u_zero])
            else:
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                if negative >= 0:
                    d = np.concatenate([prior * (as_one - as_zero), u_zero])
                else:  # the estimate of the negatives' risk is below 0: step back from it
                    d = np.concatenate([prior * as_zero, -u_zero])
            dh = np.outer(d, theta[2]) * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * theta[0], dh.sum(0), h.T @ d + 1e-4 * theta[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                theta[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return PuModel(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), 1.0 if prior is None else prior)


def estimate_prior(p: np.ndarray, u: np.ndarray, least: float = 0.1) -> float:
    """The share of positives among unlabelled scores.

    Above any threshold the unlabelled share is at least the prior times the positives' share; the
    smallest ratio over thresholds that keep a share ``least`` of the positives bounds the prior.
    """
    cuts = np.quantile(p, np.linspace(0, 1 - least, 50))
    ratios = [(u >= c).mean() / max((p >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.99))


def fit(p: np.ndarray, u: np.ndarray, hidden: int = 16, epochs: int = 30, rate: float = 0.003, seed: int = SEED) -> PuModel | None:
    """A model from trusted positives and unlabelled rows; None if either is missing.

    A first classifier, fitted on half of the rows, ranks the other half, from which the prior is
    estimated; the model then minimises the non-negative risk under that prior.
    """
    if not len(p) or not len(u):
        return None
    first = _fit(p[::2], u[::2], None, 8, 10, rate, seed)
    a, b = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)
    prior = estimate_prior(first.logits(a), first.logits(b))
    return _fit(p, u, prior, hidden, epochs, rate, seed)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def _collected(df: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                x = [features(t.as_py()) for t in batch.column(0).slice(a, 512)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * FEATURES, np.concatenate(x))], ["x"])

    table = df.mapInArrow(freeing(run), "x array<float>").toArrow()
    return table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)


def train(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = SEED) -> PuModel | None:
    """Fits on rows outside fold 0: trusted ones are those labelled 1, unlabelled ones any documents.

    At most ``positives`` and ``unlabelled`` rows of lowest hash are taken, by a narrow pass over the ids;
    only those ids are broadcast, so their number is the bound. Null and repeated labels are ignored.
    """
    trusted = labels.where((F.col(label) == 1) & (fold(F.col(label_key)) != 0)).select(F.col(label_key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(positives)
    some = docs.where(fold(F.col(key)) != 0).select(F.col(key).alias("k")).orderBy(F.xxhash64("k", F.lit(1)), "k").limit(unlabelled)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = [_collected(rows.join(F.broadcast(ids.distinct()), "k", "left_semi").orderBy("k").select("t")) for ids in (trusted, some)]
    return fit(*found, seed=seed)


def score(docs: DataFrame, text: str, model: PuModel | None, name: str = "score") -> DataFrame:
    """Adds the score of every whole text, 0 to 1; without a model 0.5. A column of that name is replaced."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [np.zeros(0)]
            for a in range(0, len(texts), 512):
                part = texts.slice(a, 512)
                out.append(np.full(len(part), 0.5) if model is None else model.scores(np.stack([features(t.as_py()) for t in part]).astype(np.float64)))
            yield pa.array(np.concatenate(out))

    # The annotations tell Spark that this is an iterator's function; a closure's own would be strings.
    scored = freeing(run)
    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(scored, "double")(F.col(text)))


def classify(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` with held_out, score and predicted; nothing but the text is an input of the score.

    held_out is true for fold 0, whose labels are never seen, and false for null keys. Null texts are
    scored as empty ones. Without positives every score is 0.5.
    """
    model = train(docs, key, text, labels, label_key, label, **options)
    out = score(docs.withColumn("held_out", F.coalesce(fold(F.col(key)) == 0, F.lit(False))), text, model)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
