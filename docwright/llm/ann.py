"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes of ``BITS`` bits from learned rotations (``itq``), cut into substrings of 16
bits (32 from 2^24 rows on, so that buckets stay small), each indexed in a table of its own. A code within Hamming radius r of a query's code is, in at least one of the m substrings, within r // m
bits (pigeonhole), so probing the values within r // m bits of the query's own in every table retrieves every code within the
radius. What is retrieved is filtered by the whole code's distance and reranked with the original vectors in double
precision. The radius is learned: it holds the neighbours of ``coverage`` of the sampled queries. A query that finds fewer
than k codes takes the radius at which it has k.

Two physical plans give the codes within the radius:

* the tables are joined with the probes on (table, value). Codes and ids travel, vectors only for the survivors of the
  filter, and what is shipped grows with rows, queries and hits. The size of the join is counted before, from the sizes of
  buckets;
* where probing would touch more than ``SCAN`` of all (query, row) pairs the tables cannot prune: neighbours are so far that
  the pigeonhole radius of a substring covers much of its values (as for vectors without structure). Then shards of codes
  meet blocks of queries and all distances are taken by bit counts, which costs less than the probes; each (shard, block) is
  one bounded task.

Largest inner product becomes nearness by one more component, sqrt(longest^2 - |x|^2), that queries have as 0. Of equal
vectors only the k + 1 with the smallest ids can be among a query's k nearest, so a vector that many rows share is no hot group.

Edge cases: vectors that are null, zero, of another length than the commonest, or with null or non-finite components take no
part, nor do rows with a null vec_id. Rows with one vec_id are one vector, the smallest. Ties go to the smaller vec_id.
With fewer than k candidates all are returned. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks_for, one_thread
from .itq import Codes, sample, takes_part, usual_size

BITS, SHARD, QUERIES, COVERAGE, SCAN, AT_ONCE = 256, 32768, 16384, 0.98, 0.02, 32
FOUND = "query_id long, vec_id long, score double"


def _longer(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _asking(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def packed(codes: Codes, x: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) words of the codes of rows x."""
    bits = np.concatenate([codes(x[i : i + 8192]) for i in range(0, len(x), 8192)]) if len(x) else np.zeros((0, BITS), dtype=np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def distances(asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(queries, rows) numbers of differing bits."""
    out = np.zeros((len(asked), len(at)), dtype=np.int16)
    for a, b in zip(asked.T, at.T, strict=True):
        out += np.bitwise_count(a[:, None] ^ b[None, :])
    return out


def learn(x: np.ndarray, longest: float, n: int, k: int, bits: int = BITS, coverage: float = COVERAGE) -> tuple[Codes, int]:
    """The codes and the radius, from sampled rows x of n."""
    codes = Codes(_longer(x, longest), bits)
    asked = x[:512]
    far = distances(packed(codes, _asking(asked)), packed(codes, _longer(x, longest)))
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    # The j-th neighbour in the sample is about as far as the k-th among all.
    j = min(max(1, round(k * len(x) / max(n, 1))), max(1, len(x) - 1))
    near = np.argsort(-score, axis=1)[:, :j]
    return codes, int(np.quantile(np.take_along_axis(far, near, axis=1), coverage)) if len(asked) else bits


def part_of(n: int) -> int:
    """Bits of a substring for n rows."""
    return 16 if n < 2**24 else 32


def masks(flips: int, part: int) -> list[int]:
    """Values of a substring with up to ``flips`` bits set."""
    return [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(part), n)]


def best_of(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, nearest first, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(ids) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def scan(ids: np.ndarray, x: np.ndarray, words: np.ndarray, own: np.ndarray, q: np.ndarray, asked: np.ndarray, radius: int, k: int) -> pd.DataFrame:
    """The k best rows within the radius for each query, or within the distance of the k-th nearest code where that is larger."""
    out = []
    for i in range(0, len(own), AT_ONCE):
        far = distances(asked[i : i + AT_ONCE], words)
        for me, v, d in zip(own[i : i + AT_ONCE], q[i : i + AT_ONCE], far, strict=True):
            d[ids == me] = BITS + 1
            reach = max(radius, int(np.partition(d, k - 1)[k - 1])) if len(d) > k else BITS
            rows = np.flatnonzero(d <= min(reach, BITS))
            score = np.einsum("ij,j->i", x[rows], v)
            best = best_of(ids[rows], score, k)
            out.append((np.full(len(best), me), ids[rows][best], score[best]))
    return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query_id", "vec_id", "score"))})


def _by_scan(data: DataFrame, asks: DataFrame, sent, k: int, n: int, asked: int, shard: int, queries: int) -> DataFrame:
    """Every (shard, block of queries) in a task of its own."""
    shards, blocks = blocks_for(n, shard), blocks_for(asked, queries)
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = data.select("vec_id", "embedding", deal(shards).alias("shard"), every(blocks).alias("block"))
    asking = asks.select("vec_id", "embedding", every(shards).alias("shard"), deal(blocks).alias("block"))

    def found(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        codes, radius, longest = sent.value
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        at, v = (np.stack(d["embedding"].to_numpy()).astype(np.float64) for d in (x, q))
        return scan(x["vec_id"].to_numpy(), at, packed(codes, _longer(at, longest)), q["vec_id"].to_numpy(), v, packed(codes, _asking(v)), radius, k)

    return rows.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInPandas(found, FOUND)


def _coded(rows: DataFrame, sent, asking: bool, part: int) -> DataFrame:
    """vec_id, words (the code as longs), parts (its substrings)."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        codes, _radius, longest = sent.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                w = packed(codes, _asking(x) if asking else _longer(x, longest))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "words": list(w.view(np.int64)), "parts": list(w.view(f"u{part // 8}").astype(np.int64))})

    return rows.select("vec_id", "embedding").mapInPandas(code, "vec_id long, words array<long>, parts array<long>")


def _by_tables(data: DataFrame, asks: DataFrame, sent, scratch: Scratch, k: int, n: int, asked: int, most: float) -> DataFrame | None:
    """The same by joining tables and probes; None if that would meet more than ``most`` (query, row) pairs."""
    _codes, radius, _longest = sent.value
    part = part_of(n)
    tables = BITS // part
    flips = radius // tables
    if tables * sum(comb(part, i) for i in range(flips + 1)) > most * 2**part * 4:
        return None
    at = scratch.table(_coded(data, sent, False, part), "codes")
    asking = scratch.table(_coded(asks, sent, True, part), "asking")
    table = at.select("vec_id", "words", "parts", F.posexplode("parts").alias("t", "value"))
    probed = F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks(flips, part)]), lambda m: F.col("value").bitwiseXOR(m))).alias("value")
    probes = asking.select(F.col("vec_id").alias("query_id"), F.col("words").alias("q_words"), F.col("parts").alias("q_parts"), F.posexplode("parts").alias("t", "value")).select("query_id", "q_words", "q_parts", "t", probed)
    met = table.groupBy("t", "value").count().join(probes.groupBy("t", "value").agg(F.count(F.lit(1)).alias("asked")), ["t", "value"])
    if (met.agg(F.sum(F.col("count").cast("double") * F.col("asked"))).first()[0] or 0.0) > most * n * asked:
        return None
    bits = lambda a, b: F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    total = F.aggregate(bits("words", "q_words"), F.lit(0), lambda s, b: s + b)
    # A pair that several tables find counts in the first.
    first = F.array_position(F.transform(bits("parts", "q_parts"), lambda b: (b <= flips).cast("int")), 1) - 1
    pairs = table.join(probes, ["t", "value"]).filter((F.col("vec_id") != F.col("query_id")) & (total <= radius) & (F.col("t") == first)).select("query_id", "vec_id")
    pairs = scratch.table(pairs, "pairs")
    short = asks.join(pairs.groupBy(F.col("query_id").alias("vec_id")).count().filter(F.col("count") >= k).select("vec_id"), "vec_id", "left_anti")
    q = asks.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    product = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(data.select("vec_id", "embedding"), "vec_id").join(q, "query_id").select("query_id", "vec_id", product.alias("score"))
    short = scratch.table(short, "short")
    few = short.count()
    return scored.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(_by_scan(data, short, sent, k, n, few, SHARD, QUERIES)) if few else scored


def search(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, queries: int = QUERIES, coverage: float = COVERAGE, scan_share: float = SCAN) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query's vector with other rows.

    ``scan_share``: the share of (query, row) pairs that tables may meet before codes are scanned instead.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    fine = vectors.filter(takes_part("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    size = usual_size(fine, "embedding")
    rows = fine.filter(F.size("embedding") == size).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = scratch.table(rows.withColumn("asks", is_query).withColumn("same", F.xxhash64("embedding")), "rows")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    asked, longest = rows.agg(F.count_if("asks"), F.sqrt(F.max(square))).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    equal = F.row_number().over(Window.partitionBy("same", "embedding").orderBy("vec_id"))
    data = scratch.table(rows.withColumn("nth", equal).filter(F.col("nth") <= k + 1).select("vec_id", "embedding"), "data")
    n = data.count()
    codes, radius = learn(sample(data, "vec_id", "embedding"), longest, n, k, coverage=coverage)
    sent = vectors.sparkSession.sparkContext.broadcast((codes, radius, longest))
    asks = rows.filter("asks").select("vec_id", "embedding")
    best = _by_tables(data, asks, sent, scratch, k, n, asked, scan_share)
    if best is None:
        best = _by_scan(data, asks, sent, k, n, asked, shard, queries)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
