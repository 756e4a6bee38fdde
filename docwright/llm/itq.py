"""Iterative quantisation: rotations learned so that signs make balanced binary codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4096


def takes_part(c: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(c).isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def usual_size(df: DataFrame, c: str) -> int:
    """The commonest length of the vectors (the smaller, if equal); 0 if there are none."""
    r = df.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return r[0]["d"] if r else 0


def sample(df: DataFrame, key: str, c: str, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` vectors, those with the smallest hash of their key: the bounded sample that rotations are fitted on."""
    rows = df.select(F.xxhash64(key).alias("h"), key, c).orderBy("h", key).limit(most).collect()
    return np.array([r[c] for r in rows], dtype=np.float64)


def rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """(d, bits) for centred rows x; bits is at most d."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    bits = min(bits, d)
    _w, axes = np.linalg.eigh(x.T @ x + 1e-12 * np.eye(d))
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _s, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


class Codes:
    """Binary codes of ``bits`` bits from as many rotations as that takes."""

    def __init__(self, x: np.ndarray, bits: int, seed: int = 11):
        self.mean = x.mean(axis=0)
        d = x.shape[1]
        self.matrix = np.concatenate([rotation(x - self.mean, d, seed + i) for i in range(-(-bits // d))], axis=1)[:, :bits]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(n, bits) of 0 and 1."""
        return ((x - self.mean) @ self.matrix > 0).astype(np.uint8)
