"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed five-word shingles (lower case, blank-separated words; a text of one to four words is one
shingle). Documents with one set are one representative with a count. In each of ``runs`` runs a set follows random paths:
at the root every token is chosen with probability 1 / (threshold * size), by a hash of run and token, and each chosen token
leads to a child node. Sets that share chosen tokens meet. Nodes of up to ``small`` sets are compared by brute force; only
the sets of larger ones are split further, down to ``DEPTH``: below the root a node chooses, by a hash of node and token, about
``CHOICES`` of a set's ``SAMPLE`` tokens with the smallest hashes (all tokens of a smaller set), so that texts need not be read
again. Runs are repeated until the chance to miss a pair at the threshold, even one that only meets in large nodes, and the
chance that its sketches differ too much are below ``miss`` together.

The brute force in a node compares sketches of one byte of each of ``SKETCH`` minwise hashes and leaves a forest of edges. In a
node that is still larger than ``small`` at the last depth every set is compared with the node's first one; those that are
unlike it are compared with all others in blocks, so near copies cost one comparison each and unlike texts that share a
passage make no family. Components of the edges are families; within a family all pairs are compared exactly, by intersections of whole sets. Families are
dealt in chunks that meet pair by pair, so no family is gathered in one task. Rows leave as counts of links and one edge each,
never as pairs. A row is named by a 64-bit hash of (doc_id, text).

Edge cases: null, empty and blank texts have no set: class of their own, no links. Repeated rows (doc_id, text) count as
copies. Ids that are equal with different texts are different documents; a class's id is its smallest doc_id, null only if
all are. Extra columns are ignored by ``join`` and kept by ``keep_first``. Very long texts are whole. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, mix64, one_thread, row_key
from .components import components
from .vector_dedup import _groups, _reach

WORDS, LEAST, MISS, DEPTH, SMALL, CHUNK_ROWS, CHUNK_TOKENS = 5, 0.8, 5e-5, 3, 4096, 256, 1_000_000
SAMPLE, CHOICES, SKETCH, SKETCH_LEAST = 64, 3, 64, 36
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def survival(least: float = LEAST, depth: int = DEPTH) -> float:
    """Chance that a pair at the threshold, one set inside the other, shares a path of the given depth.

    At the root it expects one common token to be chosen, below it CHOICES, of the larger set's sizes.
    """
    return (1 - math.exp(-1)) * (1 - math.exp(-CHOICES)) ** (depth - 1)


def sketch_miss(least: float = LEAST) -> float:
    """Chance that a pair at the threshold agrees in less than SKETCH_LEAST bytes of its sketch."""
    same = least + (1 - least) / 256
    return sum(math.comb(SKETCH, i) * same**i * (1 - same) ** (SKETCH - i) for i in range(SKETCH_LEAST))


def runs_for(miss: float = MISS, least: float = LEAST) -> int:
    return math.ceil(math.log(max(miss - sketch_miss(least), miss / 2)) / math.log(1 - survival(least)))


_hashes = WordHashes()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _hashes(words)
    with np.errstate(over="ignore"):
        if len(h) < n:
            return mix64((h * ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
        s = h[: len(h) - n + 1] * ODD[0]
        for k in range(1, n):
            s = mix64(s) + h[k : len(h) - n + 1 + k] * ODD[k % 5]
    return np.unique(mix64(s))


def chosen(tokens: np.ndarray, runs: int, least: float = LEAST) -> np.ndarray:
    """Nodes below the roots of all runs: each token is chosen with probability 1 / (least * size)."""
    bound = np.uint64(min(2**64 - 1, int(2**64 / (least * len(tokens)))))
    found = []
    with np.errstate(over="ignore"):
        for root in mix64(np.arange(1, runs + 1, dtype=np.uint64)):
            own = tokens[tokens * (root | np.uint64(1)) <= bound]
            found.append(mix64(own + root))
    return np.concatenate(found)


SEEDS = mix64(np.arange(1001, 1001 + SKETCH, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One byte of each of SKETCH minwise hashes."""
    least = ((tokens >> np.uint64(32)).astype(np.uint32)[None, :] * SEEDS[:, None]).min(axis=1)
    return ((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def sampled(tokens: np.ndarray) -> np.ndarray:
    """The SAMPLE tokens with the smallest hashes (sorted tokens are in the order of their hashes), as their upper halves."""
    return (tokens[:SAMPLE] >> np.uint64(32)).astype(np.uint32)


def children(nodes: np.ndarray, samples: list[np.ndarray], least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each row's node: the node chooses tokens of the row's sample, each with probability CHOICES / (least * size)."""
    size = np.array([len(x) for x in samples])
    row = np.repeat(np.arange(len(nodes)), size)
    bound = np.minimum(CHOICES / (least * size), 1.0)
    with np.errstate(over="ignore"):
        h = mix64(mix64(np.concatenate(samples).astype(np.uint64)) ^ mix64(nodes)[row])
    taken = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < bound[row]
    return row[taken], mix64(h[taken] + np.uint64(1))


PARTS = [f"s{i}" for i in range(1, SKETCH // 8 + 1)]  # the sketch as longs
SETS = f"row long, doc_id string, n int, f1 long, f2 long, {', '.join(f'{s} long' for s in PARTS)}, sample binary, nodes array<long>"


def sets(docs: DataFrame, runs: int, least: float = LEAST) -> DataFrame:
    """Of every row: size, fingerprint, sketch and first nodes of its set; n is 0 and the rest null without one."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SETS.split(", ")][2:]
        for pdf in batches:
            if not len(pdf):
                continue
            rows = []
            for text in pdf["text"]:
                t = shingles(text)
                if not len(t):
                    rows.append((0, *[None] * (len(names) - 1)))
                    continue
                with np.errstate(over="ignore"):
                    f = np.array([mix64(t).sum(), mix64(t ^ ODD[2]).sum()]).view(np.int64)
                rows.append((len(t), f[0], f[1], *sketch(t).view(np.int64), sampled(t).tobytes(), chosen(t, runs, least).view(np.int64)))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "row", pdf["row"].to_numpy())
            out.insert(1, "doc_id", pdf["doc_id"].to_numpy())
            yield out.astype(dict.fromkeys(("f1", "f2", *PARTS), "Int64"))

    # Ids go through Python as text, since nulls would turn longs into doubles.
    out = docs.select("row", F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(of, SETS)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def deeper(at: DataFrame, reps: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, rep, sketch) of the children of the nodes in ``at`` (key, rep)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            row, key = children(pdf["key"].to_numpy().view(np.uint64), [np.frombuffer(x, dtype=np.uint32) for x in pdf["sample"]], least)
            out = pdf[["rep", *PARTS]].iloc[row]
            out.insert(0, "key", key.view(np.int64))
            yield out

    return at.join(reps.select("rep", *PARTS, "sample"), "rep").select("key", "rep", *PARTS, "sample").mapInPandas(of, f"key long, rep long, {', '.join(f'{s} long' for s in PARTS)}")


def _node_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest edges among the rows of small nodes whose sketches are close; input sorted by key."""
    for pdf in _groups(batches, ["key"]):
        key, rep = pdf["key"].to_numpy(), pdf["rep"].to_numpy()
        s = _bytes(pdf, PARTS)
        pairs, at, d = [], np.arange(len(key)), 1
        while len(at):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            close = at[(s[at] == s[at + d]).sum(axis=1) >= SKETCH_LEAST]
            pairs.append(np.stack([close, close + d]))
            d += 1
        yield _forest(rep, *(np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=int)))


def _bytes(pdf: pd.DataFrame, parts: list[str]) -> np.ndarray:
    return np.ascontiguousarray(pdf[parts].to_numpy(dtype=np.int64)).view(np.uint8)


def _forest(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Edges (a, b) to the first row of each component of the pairs of places."""
    lab = np.arange(len(rep))
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    keep = rep[lab] != rep
    return pd.DataFrame({"a": rep[keep], "b": rep[lab[keep]]}).drop_duplicates()


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds close: whether a row's sketch is close to that of its node's first row."""
    for pdf in batches:
        if len(pdf):
            close = (_bytes(pdf, PARTS) == _bytes(pdf, [f"l_{p}" for p in PARTS])).sum(axis=1) >= SKETCH_LEAST
            yield pdf[["key", "rep", "first", *PARTS]].assign(close=close)


def _block_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest edges between the asking rows and the others of a block; input sorted by key, block, other."""
    for pdf in _groups(batches, ["key", "block", "other"]):
        for _, g in pdf.groupby(["key", "block", "other"], sort=False):
            s, asks = _bytes(g, PARTS), g["asks"].to_numpy()
            mine, all_ = np.flatnonzero(asks), np.flatnonzero(~asks)
            hits = [all_[(s[all_] == s[i]).sum(axis=1) >= SKETCH_LEAST] for i in mine]
            if hits:
                yield _forest(g["rep"].to_numpy(), np.repeat(mine, list(map(len, hits))), np.concatenate(hits))


def large_node_edges(rows: DataFrame, big: DataFrame, reps: DataFrame, scratch: Scratch, small: int) -> DataFrame:
    """(a, b) edges of nodes of more than ``small`` sets."""
    parts = ", ".join(f"{s} long" for s in PARTS)
    leaders = big.select("key", "first").join(reps.select(F.col("rep").alias("first"), *[F.col(p).alias(f"l_{p}") for p in PARTS]), "first")
    leaders = scratch.table(leaders, "leaders")
    # Leaders are one row a node and their number has no bound; a hot node's rows are split by Spark.
    judged = scratch.table(rows.join(leaders.hint("merge"), "key").mapInPandas(_judged, f"key long, rep long, first long, {parts}, close boolean"), "judged")
    edges = judged.filter("close and rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    half = max(1, small // 2)
    nodes = judged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("close")).alias("far")).filter("far > 0")
    nodes = scratch.table(nodes.select("key", F.ceil(F.col("n") / half).cast("int").alias("others"), F.ceil(F.col("far") / half).cast("int").alias("blocks")), "nodes")
    if nodes.isEmpty():
        return edges
    rows = judged.join(nodes.hint("merge"), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("rep", "key"), F.col(n)).cast("int")
    asking = rows.filter(~F.col("close")).select("key", "rep", *PARTS, F.lit(True).alias("asks"), deal("blocks").alias("block"), every("others").alias("other"))
    asked = rows.select("key", "rep", *PARTS, F.lit(False).alias("asks"), every("blocks").alias("block"), deal("others").alias("other"))
    met = asking.union(asked).repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")
    return edges.union(met.mapInPandas(_block_edges, "a long, b long").distinct())


def candidate_edges(reps: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """(a, b) edges whose components hold every pair that met in a small node with close sketches."""
    out = None
    rows = reps.select(F.explode("nodes").alias("key"), "rep", *PARTS)
    for depth in range(1, DEPTH + 1):
        if depth > 1:
            rows = scratch.table(deeper(rows.join(big.select("key"), "key").select("key", "rep"), reps), f"rows{depth}")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).filter("size > 1")
        sizes = scratch.table(sizes, f"sizes{depth}")
        # The number of nodes has no bound, so the join is never a broadcast; what is hot on the left is large and not in it.
        few = rows.join(sizes.filter(F.col("size") <= small).select("key").hint("merge"), "key").repartition("key").sortWithinPartitions("key")
        edges = few.select("key", "rep", *PARTS).mapInPandas(_node_edges, "a long, b long").distinct()
        edges = scratch.table(edges, f"edges{depth}")
        out = edges if out is None else out.union(edges)
        big = sizes.filter(F.col("size") > small)
        if big.isEmpty():
            return out
    return out.union(scratch.table(large_node_edges(rows, big, reps, scratch, small), "rest"))


def exact_links(token_sets: list[np.ndarray], copies: np.ndarray, chunk: np.ndarray, apart: bool, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(links, weighted by copies; the smallest row reached), over all pairs of the sets; only across chunks if apart."""
    n = np.array([len(t) for t in token_sets])
    owner = np.repeat(np.arange(len(n)), n)
    _, code, seen = np.unique(np.concatenate(token_sets), return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    number = np.cumsum(seen > 1) - 1
    owner, column = owner[shared], number[code[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(n), len(n)), dtype=np.float64)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(n), width), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T
    near = both >= least * (n[:, None] + n[None, :] - both) - 1e-9
    np.fill_diagonal(near, False)
    if apart:
        near &= chunk[:, None] != chunk[None, :]
    return near @ copies, _reach(near)


def _compare(least: float):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for pdf in _groups(batches, ["family", "i", "j"]):
            out = []
            for (_family, i, j), g in pdf.groupby(["family", "i", "j"], sort=False):
                if len(g) < 2:
                    continue
                g = g.sort_values("rep")
                ids = g["rep"].to_numpy()
                n, reach = exact_links([shingles(t) for t in g["text"]], g["copies"].to_numpy(), g["chunk"].to_numpy(), i != j, least)
                keep = (n > 0) | (ids[reach] != ids)
                out.append(pd.DataFrame({"rep": ids[keep], "n": n[keep], "to": ids[reach][keep]}))
            if out:
                yield pd.concat(out)

    return compare


def join(docs: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """row, doc_id, class_id, n_links, first of every row of docs; ``first`` is the row key of its class's first document."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    keyed = docs.select(F.col("doc_id"), F.col("text"), row_key(docs, "doc_id", "text").alias("row"))
    found = scratch.table(sets(keyed, runs_for(miss, least), least), "sets")
    groups = found.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "row")).alias("at"), F.count(F.lit(1)).alias("copies"))
    groups = scratch.table(groups.select("n", "f1", "f2", F.col("at.row").alias("rep"), F.col("at.doc_id").alias("rep_doc"), "copies"), "groups")
    # Copies have equal sets, so the representative's row is one of them; repeated rows must not count twice here.
    reps = found.filter("n > 0").join(groups.select("rep"), F.col("row") == F.col("rep"), "left_semi").dropDuplicates(["row"])
    reps = scratch.table(reps.withColumnRenamed("row", "rep").drop("doc_id", "f1", "f2"), "reps")
    found_path = found.select("row", "doc_id", "n", "f1", "f2")
    edges = candidate_edges(reps, scratch)
    family = components(edges, scratch).withColumnRenamed("node", "rep").withColumnRenamed("component", "family")
    member = scratch.table(family.join(groups.select("rep", "n", "copies"), "rep"), "members")
    sizes = scratch.table(member.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("int").alias("chunks")), "families")
    member = scratch.table(member.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")), "dealt")
    # The number of members has no bound, so this is never a broadcast.
    texts = keyed.join(member.withColumnRenamed("rep", "row").hint("merge"), "row")
    if _repeats(found_path):
        texts = texts.groupBy("row").agg(*[F.first(c).alias(c) for c in ("text", "family", "chunk", "chunks", "copies")])
    texts = texts.select(F.col("row").alias("rep"), "text", "family", "chunk", "copies", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    texts = texts.select("family", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "copies", "text")
    links = scratch.table(texts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInPandas(_compare(least), "rep long, n long, to long"), "links")
    counted = links.groupBy("rep").agg(F.sum("n").alias("links"))
    parts = components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch).withColumnRenamed("node", "rep")
    whole = groups.join(counted, "rep", "left").join(parts, "rep", "left").select("n", "f1", "f2", "rep", "rep_doc", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    whole = scratch.table(whole, "whole")
    first = scratch.table(whole.groupBy("component").agg(F.min("rep_doc").alias("class_id"), F.min(F.struct("rep_doc", "rep")).alias("at")).select("component", "class_id", F.col("at.rep").alias("first")), "classes")
    done = scratch.table(whole.join(first, "component").select("n", "f1", "f2", "n_links", "class_id", "first"), "done")
    out = found_path.join(done, ["n", "f1", "f2"], "left")
    return out.select("row", "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "row").alias("first"))


def _repeats(found: DataFrame) -> bool:
    return not found.groupBy("row").count().filter("count > 1").isEmpty()


def keep_first(docs: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """The rows of docs that are the first of their class, one row each, with all their columns."""
    scratch = Scratch(docs.sparkSession, "jaccard-keep")
    kept = scratch.table(join(docs, least, miss).filter("row = first").select(F.col("row").alias("_first")).distinct(), "kept")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), row_key(docs, "doc_id", "text").alias("_row"))
    rows = rows.join(kept, F.col("_row") == F.col("_first"), "left_semi")
    if not docs.groupBy(row_key(docs, "doc_id", "text").alias("r")).count().filter("count > 1").isEmpty():
        rows = rows.groupBy("_row").agg(F.first("doc").alias("doc"))
    return rows.select("doc.*")
