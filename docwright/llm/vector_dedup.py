"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

Equal vectors of a label are one representative with a count. Representatives get a learned binary code that is cut into
``tables`` substrings; a table groups rows of a label by the value of its substring. Two codes that differ in fewer bits
than there are tables share a bucket (pigeonhole), and pairs at the threshold share one, and lie within the Hamming radius,
with probability 1 - ``miss``: substring length follows the number of rows, and the number of tables and the radius follow
from how often bits differ in pairs at the threshold around sampled vectors, as measured, since vectors that share a
direction lie wider apart after centring. In a bucket codes are compared first; pairs within the radius are compared by cosine in
double precision. A pair counts in the first table that it shares. Rows leave a bucket as a count of links and one edge
towards the smallest row that they reach there, never as pairs.

A bucket of more than ``most`` rows is dealt into chunks that meet pair by pair, each pair of chunks in a task of its own.

Edge cases: vectors that are null, zero, of another length than the commonest, or with null or non-finite components, and rows
with a null label, link with nothing. Rows with one vec_id are one vector, the one with the smallest (label, embedding); a
null vec_id is one row without links. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, one_thread
from .components import components
from .itq import Codes, sample, takes_part, usual_size

LEAST, PER_BUCKET, MISS, MOST = 0.98, 32, 1e-5, 2048


def differing(x: np.ndarray, least: float = LEAST, seed: int = 5) -> np.ndarray:
    """Of pairs at cosine ``least``, one at each of the unit vectors x: the share of code bits that differ."""
    d = x.shape[1]
    codes = Codes(x, 8 * d)
    side = np.random.default_rng(seed).standard_normal(x.shape)
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    return (codes(x) != codes(least * x + math.sqrt(1 - least**2) * side)).mean(axis=1)


def shape(n: int, x: np.ndarray, least: float = LEAST, per_bucket: int = PER_BUCKET, miss: float = MISS) -> tuple[int, int, int]:
    """(tables, bits of a substring, Hamming radius) for labels of up to n rows, from sampled unit vectors x."""
    bits = min(20, max(6, math.ceil(math.log2(max(2, n / per_bucket)))))
    p = np.clip(differing(x, least), 1e-3, 0.5)
    tables = 1
    while ((1 - (1 - p) ** bits) ** tables).mean() > miss / 2:
        tables += 1
    total = tables * bits
    at = np.arange(total + 1)
    choose = np.array([math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) for i in at])
    exactly = np.exp(choose + at * np.log(p)[:, None] + (total - at) * np.log1p(-p)[:, None]).mean(axis=0)
    beyond = 1 - np.cumsum(exactly)
    return tables, bits, int(np.argmax(beyond <= miss / 2))


def _reach(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it reaches by links."""
    lab = np.arange(len(linked))
    while True:
        new = np.minimum(lab, np.where(linked, lab, len(lab)).min(axis=1, initial=len(lab)))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def bucket_links(counts, x, code, table: int, bits: int, radius: int, chunk, i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links first seen in this table, weighted by counts; the smallest row reached) of a bucket's rows, ordered by id.

    ``code``: (n, tables * bits) of 0 and 1.
    """
    n = len(x)
    words = np.packbits(code, axis=1)
    words = np.pad(words, ((0, 0), (0, -words.shape[1] % 8))).view(np.uint64)
    far = np.zeros((n, n), dtype=np.int16)
    for w in words.T:
        far += np.bitwise_count(w[:, None] ^ w[None, :])
    near = far <= radius
    np.fill_diagonal(near, False)
    if i != j:  # rows of one chunk meet in the group of that chunk alone
        near &= chunk[:, None] != chunk[None, :]
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    a, b = np.nonzero(near)
    if len(a) * 8 < n * n:
        near[a, b] = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
    else:
        near &= unit @ unit.T >= least
    first = near.copy()
    for s in range(table):
        own = code[:, s * bits : (s + 1) * bits] @ (1 << np.arange(bits))
        first &= own[:, None] != own[None, :]
    return first @ counts, _reach(near)


def find_links(vectors: DataFrame, least: float = LEAST, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    one = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")
    one = scratch.table(one.withColumn("fine", takes_part("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()), "vectors")
    fine = one.filter("fine")
    size = usual_size(fine, "embedding")
    reps = scratch.table(fine.filter(F.size("embedding") == size).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    if not largest:
        return one.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    x = sample(reps, "rep", "embedding")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables, bits, radius = shape(largest, x, least)
    # Single-precision vectors are shipped as such; they are compared in double precision.
    dtype = np.dtype("<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8")
    sent = spark.sparkContext.broadcast(Codes(x, tables * bits))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        weights = (1 << np.arange(bits)).astype(np.uint64)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            b = sent.value(x / np.linalg.norm(x, axis=1, keepdims=True))
            value = (b.reshape(len(x), tables, bits).astype(np.uint64) * weights).sum(axis=2)
            key = mix64(mix64(value * np.uint64(64) + np.arange(tables, dtype=np.uint64)) ^ pdf["label"].to_numpy().astype(np.int64).astype(np.uint64)[:, None]).astype(np.int64)
            yield pd.DataFrame({"rep": pdf["rep"], "copies": pdf["copies"], "label": pdf["label"], "x": [r.tobytes() for r in x.astype(dtype)], "code": [r.tobytes() for r in np.packbits(b, axis=1)], "keys": list(key)})

    coded = scratch.table(reps.mapInPandas(code, "rep long, copies long, label long, x binary, code binary, keys array<long>"), "codes")
    rows = coded.select("rep", "copies", "label", "x", "code", F.posexplode("keys").alias("table", "key"))
    sizes = scratch.table(coded.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1"), "sizes")
    rows = rows.join(sizes, "key").withColumn("chunks", F.ceil(F.col("count") / most).cast("int"))
    rows = rows.withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("rep"), F.col("chunks"))).otherwise(0).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).select("key", "table", "i", "j", "chunk", "rep", "copies", "label", "x", "code")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for pdf in _groups(batches, ["key", "table", "i", "j"]):
            out = []
            for (_key, table, i, j, _label), g in pdf.groupby(["key", "table", "i", "j", "label"], sort=False):
                if len(g) < 2:
                    continue
                g = g.sort_values("rep")
                ids = g["rep"].to_numpy()
                x = np.frombuffer(b"".join(g["x"]), dtype=dtype).reshape(len(g), -1).astype(np.float64)
                own = np.unpackbits(np.frombuffer(b"".join(g["code"]), dtype=np.uint8).reshape(len(g), -1), axis=1, count=tables * bits)
                n, reach = bucket_links(g["copies"].to_numpy(), x, own, table, bits, radius, g["chunk"].to_numpy(), i, j, least)
                keep = (n > 0) | (ids[reach] != ids)
                out.append(pd.DataFrame({"rep": ids[keep], "n": n[keep], "to": ids[reach][keep]}))
            if out:
                yield pd.concat(out)

    found = scratch.table(rows.repartition("key", "i", "j").sortWithinPartitions("key", "table", "i", "j").mapInPandas(compare, "rep long, n long, to long"), "links")
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch)
    done = reps.join(counted, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    done = scratch.table(done.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "done")
    out = one.withColumn("label", F.when(F.col("fine"), F.col("label"))).join(done, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream that is sorted by key; what may go on in the next batch is held back."""
    rest = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = (pdf[key] == pdf[key].iloc[-1]).all(axis=1).to_numpy()
        begin = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        if last.all() and rest and (rest[-1][key].iloc[-1] == pdf[key].iloc[0]).all():
            rest.append(pdf)
            continue
        yield_now = [*rest, pdf.iloc[:begin]]
        if sum(map(len, yield_now)):
            yield pd.concat(yield_now)
        rest = [pdf.iloc[begin:]]
    if rest:
        yield pd.concat(rest)
