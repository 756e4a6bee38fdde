"""Vector top-k, reranking, citations and scores of retrieval."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwright.functions.vectors import dot

#: Query vectors of a block and chunks of a shard.
BLOCK, SHARD = 1024, 16384
#: By expressions: chunks that give a bound, pairs of a task, and the most components that stand in a pair's expression (a JVM leaves long methods uncompiled).
FIRST, PAIRS, WIDE = 1024, 1 << 22, 128


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 6, tenant: str | None = None, exact: bool = True) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of ``chunks`` (vec_id, embedding) by rounded cosine, ties to smaller vec_id, without the query itself.

    Up to ``BLOCK`` queries go to every task, and the chunks are read once without a shuffle. More queries are dealt into
    blocks and the chunks into shards; each (shard, block) is one bounded task. Either way a task keeps k rows for a query, so
    what is shuffled grows with tasks and queries and not with pairs. With ``tenant`` only chunks of that tenant_id take part.
    """
    if tenant is not None:
        chunks = chunks.filter(F.col("tenant_id") == tenant)
    chunks = chunks.filter(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    queries = queries.select("query_id", "embedding")
    if not exact:
        return _pairs(queries, chunks, k, digits)
    found = "query_id long, vec_id long, score double"
    first = queries.limit(BLOCK + 1).toPandas()  # a bounded number
    if len(first) <= BLOCK:

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = None
            for pdf in batches:
                kept = _best(first, pdf, k, digits, kept)
            if kept is not None:
                yield kept

        return ranked(chunks.mapInPandas(scan, found), k)
    blocks, shards = -(-queries.count() // BLOCK), -(-chunks.count() // SHARD)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "embedding", deal("query_id", blocks).alias("block"), every(max(1, shards)).alias("shard"))
    c = chunks.select("vec_id", "embedding", every(blocks).alias("block"), deal("vec_id", max(1, shards)).alias("shard"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = _best(left, right, k, digits)
        return out if out is not None else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return ranked(q.groupBy("shard", "block").cogroup(c.groupBy("shard", "block")).applyInPandas(meet, found), k)


def _best(queries: pd.DataFrame, chunks: pd.DataFrame, k: int, digits: int, kept: pd.DataFrame | None = None) -> pd.DataFrame | None:
    """The k best (query_id, vec_id, score) of each query among the chunks and what was kept."""
    if not len(queries) or not len(chunks):
        return kept
    ids, vec = queries["query_id"].to_numpy(), chunks["vec_id"].to_numpy()
    unit = lambda e: (x := np.stack(e.to_numpy()).astype(np.float64)) / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(queries["embedding"]) @ unit(chunks["embedding"]).T, digits)
    s[(ids[:, None] == vec[None, :]) | ~np.isfinite(s)] = -np.inf
    order = np.lexsort((np.broadcast_to(vec, s.shape), -s), axis=1)[:, :k]
    out = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": vec[order].ravel(), "score": np.take_along_axis(s, order, axis=1).ravel()})
    out = out[np.isfinite(out["score"])]
    if kept is None:
        return out
    return pd.concat([kept, out]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _pairs(queries: DataFrame, chunks: DataFrame, k: int, digits: int) -> DataFrame:
    """The same by expressions. Vectors that are null, zero or hold null or non-finite components take no part, and only equal lengths meet.

    Each query is first compared with ``FIRST`` chunks; the k-th score among them is a bound that its k nearest cannot lie
    below, so of all pairs, which are compared in generated code, only those that reach the bound become rows.
    """

    def measured(df: DataFrame, key: str, e: str) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        d = df.select(key, F.col("embedding").alias(e), F.size(v).alias(f"{e}_size"), F.sqrt(dot(v, v)).alias(f"{e}_norm"))
        return d.filter(F.col(f"{e}_norm").between(sys.float_info.min, sys.float_info.max))

    def spread(df: DataFrame, e: str) -> DataFrame:
        """Components as columns, which a pair's generated code reads without checks."""
        if size > WIDE:
            return df
        return df.select(*[x for x in df.columns if x != e], *[F.coalesce(F.get(e, F.lit(i)).cast("double"), F.lit(0.0)).alias(f"{e}_{i}") for i in range(size)])

    q, c = measured(queries, "query_id", "q"), measured(chunks, "vec_id", "c")
    n, size = q.agg(F.count(F.lit(1)), F.coalesce(F.max("q_size"), F.lit(0))).first()
    n_chunks = c.count()
    q = spread(q, "q")
    product = dot(F.col("c"), F.col("q")) if size > WIDE else reduce(lambda s, i: s + F.col(f"c_{i}") * F.col(f"q_{i}"), range(size), F.lit(0.0))
    score = F.round(F.try_divide(product, F.col("c_norm") * F.col("q_norm")), digits)
    others = (F.col("vec_id") != F.col("query_id")) & (F.col("c_size") == F.col("q_size"))
    blocks = max(1, -(-n // SHARD))

    def met(c: DataFrame, tasks: int, wanted: Column, q: DataFrame) -> DataFrame:
        c, out = spread(c.repartition(tasks), "c"), []
        for b in range(blocks):
            block = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else q
            out.append(c.join(F.broadcast(block), wanted).select("query_id", "vec_id", score.alias("score")))
        return reduce(DataFrame.union, out)

    if n_chunks > FIRST:
        first = met(c.limit(FIRST), -(-n * FIRST // PAIRS) + 1, others, q)
        bounds = first.groupBy("query_id").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("bound"))
        least = (F.col("bound") - 2 * 10.0**-digits) * F.col("q_norm")
        q = q.join(bounds, "query_id", "left").withColumn("least", F.coalesce(least, F.lit(float("-inf")))).drop("bound")
        others &= product >= F.col("least") * F.col("c_norm")
    return ranked(met(c, -(-n * n_chunks // PAIRS) + 1, others, q), k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(hits: DataFrame, top_n: int = 5) -> DataFrame:
    """The top_n best of each query: a stable sort by score keeps the order of retrieval among ties."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "rank")
    return hits.withColumn("rerank", F.row_number().over(w)).filter(F.col("rerank") <= top_n)


def citation(content: Column, score: Column) -> Column:
    """span, confidence and short hash of a cited text."""
    return F.struct(F.concat(F.substring(content, 1, 100), F.lit("...")).alias("span"), score.alias("confidence"), F.substring(F.sha2(content, 256), 1, 16).alias("sha256"))


def retrieval_scores(hits: DataFrame, expected: DataFrame, k: int = 10, recall_k: int = 5, discount: str = "reciprocal", cap: str = "retrieved") -> DataFrame:
    """query_id, ndcg, recall, mrr. hits: query_id, vec_id, rank; expected: query_id, vec_id, distinct.

    ``discount``: 'reciprocal' divides by the rank, 'log2' by log2(rank + 1). The ideal gain takes the number expected, but
    at most the number retrieved in the first k (``cap='retrieved'``) or k (``cap='k'``). A query without expectation has 0.
    """
    wanted = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    hit = hits.join(expected.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return flagged_scores(hit, wanted, k, recall_k, discount, cap)


def flagged_scores(hit: DataFrame, wanted: DataFrame, k: int = 10, recall_k: int = 5, discount: str = "reciprocal", cap: str = "retrieved") -> DataFrame:
    """The same from hits that say themselves whether they were expected (query_id, vec_id, rank, hit: 1 if so) and the number expected of each query (query_id, n_expected).

    No row for each expected document is needed, which matters where a query expects a share of all of them.
    """
    gain = (lambda r: 1.0 / r) if discount == "reciprocal" else (lambda r: 1.0 / F.log2(r + 1))
    per = hit.groupBy("query_id").agg(
        F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= k), gain(F.col("rank").cast("double"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("n_retrieved"),
        F.countDistinct(F.when((F.col("hit") == 1) & (F.col("rank") <= recall_k), F.col("vec_id"))).alias("found"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
    )
    per = per.join(wanted, "query_id", "full")
    n = F.least("n_expected", F.col("n_retrieved") if cap == "retrieved" else F.lit(k))
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))), F.lit(0.0), lambda s, i: s + gain(i.cast("double")))
    return per.select(
        "query_id",
        F.coalesce(F.try_divide("dcg", ideal), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.try_divide(F.col("found").cast("double"), "n_expected"), F.lit(0.0)).alias("recall"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
    )


def mean_scores(scores: DataFrame, error: str | None = None) -> DataFrame:
    """Means of ndcg, recall, mrr over the rows without error, and the numbers of queries and errors."""
    ok = F.lit(True) if error is None else F.col(error).isNull()
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(f"mean_{c}")
    return scores.agg(mean("ndcg"), mean("recall"), mean("mrr"), F.count_if(ok).alias("n_queries"), F.count_if(~ok).alias("n_errors"))


#: The least mean of each metric before an alert.
THRESHOLDS = {"ndcg": 0.75, "recall": 0.85, "mrr": 0.6, "faithfulness": 0.7}


def alerts(means: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """metric, value, threshold of every mean_<metric> below its threshold."""
    present = [m for m in thresholds if f"mean_{m}" in means.columns]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"mean_{m}").alias("value"), F.lit(thresholds[m]).alias("threshold")) for m in present])
    return means.select(F.explode(rows).alias("r")).select("r.*").filter("value < threshold")


def keyword_hits(text: Column, keywords: Column) -> Column:
    """Whether at least half the keywords occur, without regard to case."""
    n = F.size(F.filter(keywords, lambda w: F.contains(F.lower(text), F.lower(w))))
    return F.when(F.size(keywords) == 0, True).otherwise(n >= F.size(keywords) * 0.5)


def id_overlap(a: Column, b: Column) -> Column:
    """equal, superset, overlap (at least 0.8 of b) or differs, of two id arrays."""
    common = F.size(F.array_intersect(a, b))
    nb = F.size(F.array_distinct(b))
    return F.when((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0), "equal").when(F.size(F.array_except(b, a)) == 0, "superset").when(F.try_divide(common, nb) >= 0.8, "overlap").otherwise("differs")


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct lower-case words that b has; 0 if a has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(a), words(b))).cast("double"), F.size(words(a))), F.lit(0.0))


def relevance(query: Column, answer: Column, variant: str = "runner") -> Column:
    """Of an answer to a query. runner: min(1, (overlap + min(1, length / 100)) / 2 + 0.3), 0 if empty; nightly: min(1, overlap + 0.3) over 50 characters, else 0.3."""
    o = token_overlap(query, answer)
    if variant == "runner":
        return F.when(F.coalesce(F.length(answer), F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), (o + F.least(F.lit(1.0), F.length(answer) / 100)) / 2 + 0.3))
    return F.when(F.length(answer) > 50, F.least(F.lit(1.0), o + 0.3)).otherwise(0.3)


def faithfulness(answer: Column, cited: Column, variant: str = "runner") -> Column:
    """Share of cited texts that the answer holds; 0.5 without any. runner compares the first 50 characters in lower case."""
    inside = (lambda t: F.contains(F.lower(answer), F.lower(F.substring(t, 1, 50)))) if variant == "runner" else (lambda t: F.contains(answer, t))
    return F.when(F.size(cited) == 0, 0.5).otherwise(F.size(F.filter(cited, inside)).cast("double") / F.size(cited))
