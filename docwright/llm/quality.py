"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Documents become log-scaled counts of hashed byte trigrams and of word shapes and word repeats, weighted by the inverse
document frequency of the labelled sample. A truncated singular value decomposition of that sample gives the latent space.
The labelled vectors (at most ``2 * per_class`` of ``rank`` numbers: a fixed bound) go to every task; each batch of
documents meets all of them in exact blocked cosine products. The score is the similarity-weighted share of good labels
among the ``k`` nearest.

The fit takes a bounded sample: per class the ``per_class`` training ids with the smallest hash. Everything else reads all
documents and whole texts, in one pass without a shuffle.

Edge cases: null texts are empty; an empty text is scored like any other, by its constant pseudo-term. Rows with a null
doc_id are scored. Duplicate label rows are each a vote; null labels are not. With no labels of a class all scores are that
of the other class; with none at all, 0.5. Repeated rows score alike. Of neighbours that are equally near, the first in the
order of (doc_id hash, doc_id, features) vote. ``score`` and ``keep_good`` keep extra columns; columns named score, predicted
or held_out give way to those that ``score`` adds. ``classify`` returns its four columns only. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, one_thread

BINS, EXTRA, RANK, K, PER_CLASS, FOLDS, HELD_OUT = 2048, 64, 48, 25, 1500, 3, 1
WORD = np.zeros(256, dtype=np.uint8)
WORD[[9, 10, 11, 12, 13, 32]] = 1


def features(text: str | None) -> np.ndarray:
    """Counts in BINS trigram bins, then EXTRA pseudo-terms: byte kinds, repeats of words, a constant."""
    raw = (text or "").encode()
    out = np.zeros(BINS + EXTRA, dtype=np.float32)
    out[-1] = 1.0
    if not raw:
        return out
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) > 2:
        h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        h *= np.uint32(2654435761)
        out[:BINS] = np.bincount(h >> np.uint32(21), minlength=BINS)
    words = raw.split()
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words[1:], words[:-1])) / n
    distinct = len(set(words)) / n
    upper = ((b >= 65) & (b <= 90)).mean()
    alpha = (((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)).mean()
    digit = ((b >= 48) & (b <= 57)).mean()
    marks = 1 - alpha - digit - WORD[b].mean()
    # A share falls into one of eight bins, with a weight that counts like a frequent term.
    for i, share in enumerate((same, 1 - distinct, upper, digit, marks, 1 - alpha)):
        out[BINS + 8 * i + min(7, int(share * 8))] = len(b) / 8
        out[BINS + 48 + i] = share * len(b)
    return out


def _scaled(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = x[:, :-1].sum(axis=1, keepdims=True)
    x = np.log1p(x * (2000.0 / np.maximum(total, 1.0))) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Neighbours:
    """The latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, k: int = K):
        n = len(counts)
        self.labels, self.k = labels.astype(np.float64), k
        self.idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1 if n else np.ones(counts.shape[1], dtype=np.float32)
        x = _scaled(counts, self.idf).astype(np.float32)
        rank = max(1, min(rank, n, x.shape[1]))
        q = np.random.default_rng(7).standard_normal((x.shape[1], min(x.shape[1], rank + 16))).astype(np.float32)
        for _ in range(4 if n else 0):  # subspace iteration
            q, _r = np.linalg.qr(x.T @ (x @ q))
        if n:
            _u, _s, v = np.linalg.svd(x @ q, full_matrices=False)
            q = q @ v[:rank].T
        self.basis = q[:, :rank].astype(np.float32)
        self.points = self._unit(x @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        at = self._unit(_scaled(counts, self.idf) @ self.basis)
        near = at @ self.points.T
        top = first_largest(near, min(self.k, near.shape[1]))
        w = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6).astype(np.float64) ** 4
        return (w * self.labels[top]).sum(axis=1) / w.sum(axis=1)


def first_largest(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) places of the k largest values of each row, in the order of places; of equal values the first ones."""
    least = np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k][:, None]
    above, equal = x > least, x == least
    room = k - above.sum(axis=1, keepdims=True)
    crowded = np.flatnonzero(equal.sum(axis=1) > room[:, 0])
    equal[crowded] &= np.cumsum(equal[crowded], axis=1) <= room[crowded]
    return np.nonzero(above | equal)[1].reshape(len(x), k)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rank: int = RANK, k: int = K) -> Neighbours:
    """Fits on training rows: those whose crc32(doc_id as text) modulo FOLDS is not HELD_OUT."""
    train = labels.filter((crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("h"))
    picked = train.filter("label = 0").orderBy("h", "doc_id").limit(per_class).union(train.filter("label = 1").orderBy("h", "doc_id").limit(per_class))
    rows = picked.collect()  # at most 2 * per_class
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["label"], r["h"]) for r in rows], "doc_id long, label int, h long")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "h": pdf["h"], "x": [features(t).tobytes() for t in pdf["text"]]})

    # A doc_id that many rows share gives the same bounded number of votes.
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = texts.mapInPandas(vectors, "doc_id long, label int, h long, x binary").orderBy("h", "doc_id", "x").limit(2 * per_class).collect()
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in found]) if found else np.zeros((0, BINS + EXTRA), dtype=np.float32)
    return Neighbours(x, np.array([r["label"] for r in found]), rank, k)


def score(docs: DataFrame, model: Neighbours, held: bool = True) -> DataFrame:
    """All columns of docs, then held_out, score and predicted. One pass, no shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.idf, model.basis, model.points, model.labels, model.k))

    @F.pandas_udf("double")
    def voted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one_thread()
        m = Neighbours.__new__(Neighbours)
        m.idf, m.basis, m.points, m.labels, m.k = sent.value
        for series in texts:
            values = series.tolist()
            done = [m.score(np.stack([features(t) for t in values[i : i + 256]])) for i in range(0, len(values), 256)]
            yield pd.Series(np.concatenate(done) if done else [], dtype="float64")

    out = docs.withColumn("score", voted(F.col("text")))
    out = out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return out.withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns."""
    names = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id"), F.col("text"))
    return score(wide, fit(docs, labels)).filter("predicted = 1").select("row.*")
