"""Packing by shortest-pack-first over the length histogram.

Every document becomes ids of a public byte-level vocabulary and an end id; it is cut into pieces of ``size`` ids and a
remainder. Only the histogram of piece lengths (at most ``size`` numbers) comes to the driver. There lengths are placed,
longest first, each into the packs that are shortest so far; packs of one shape are one pattern with a count, so the work
depends on the number of lengths and not of pieces. Pieces get a rank among those of their length and find pattern, copy
and place from it.

Ranks are dealt without putting a length into one task: pieces of a length go to about the root of their number of
buckets, buckets are counted, and a rank is the bucket's offset plus the place inside it.

Edge cases: a null or empty text is one end id. Repeated rows are documents of their own; equal ones are interchangeable.
Null ids are kept. Very long texts are cut like others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SIZE, END, LONG, LEAST_BUCKET = 1024, 0, 20_000, 256
#: Characters that all versions of Unicode class alike.
UNUSUAL = re.compile("[^\x00-~\u00a1-\u024f\u2010-\u2015\u2018-\u201f\u2026]")
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


class Ids:
    """Ids of a text, as the vocabulary's own library gives them.

    The same vocabulary as ranks encodes several times faster and gives the same ids; texts with special strings, unusual
    characters or very long words go to the library itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def usual(self, text: str) -> bool:
        if not text.isascii() and UNUSUAL.search(text) or any(s in text for s in self.special):
            return False
        return len(text) <= LONG or (max(map(len, text.split()), default=0) <= LONG and not re.search(r"\s{1000}", text))

    def __call__(self, text: str) -> list:
        if self.fast is not None and self.usual(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Ids(json_path, ranks_path, pattern)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*encode(text), END], dtype="<u4")
                rows += [(doc_id, s, min(size, len(ids) - s), zlib.crc32(ids[s : s + size].tobytes()), len(ids)) for s in range(0, len(ids), size)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    # Ids go through Python as text, since nulls would turn longs into doubles.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, PIECES)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(count, lengths) of each pattern; lengths of a pattern are longest first."""
    room: dict[int, list[tuple[int, tuple]]] = {}
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if most is None:
                room.setdefault(size - length, []).append((left, (length,)))
                break
            count, pattern = room[most].pop()
            taken = min(count, left)
            if count > taken:
                room[most].append((count - taken, pattern))
            room.setdefault(most - length, []).append((taken, (*pattern, length)))
            left -= taken
    return [(count, list(pattern)) for _, packs in sorted(room.items()) for count, pattern in packs]


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset), by first rank: rank r of the row goes to sequence first + r - first rank."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    first = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            out.setdefault(length, []).append((at, first, offset))
            used[length] = at + count
            offset += length
        first += count
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def ranked(found: DataFrame, histogram: dict[int, int], size: int = SIZE) -> DataFrame:
    """Adds rank, from 0, among the pieces of each length."""
    per = max(LEAST_BUCKET, int(sum(histogram.values()) ** 0.5))
    buckets = F.array(*[F.lit(max(1, -(-histogram.get(i, 0) // per))) for i in range(size + 1)])
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(buckets, F.col("length").cast("int"))).cast("long"))
    counted = found.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    return found.withColumn("inside", inside).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("bucket", "inside", "before")


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SIZE) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    scratch = Scratch(docs.sparkSession, "packing")
    found = scratch.table(pieces(docs, json_path, ranks_path, pattern, size), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `size` rows
    where = docs.sparkSession.sparkContext.broadcast(places(shortest_pack_first(histogram, size)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            for k in np.unique(length):
                rows, at = where.value[k], np.flatnonzero(length == k)
                hit = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = hit[:, 1] + rank[at] - hit[:, 0], hit[:, 2]
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    out = ranked(found, histogram, size).select(F.col("doc_id").cast("string").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "rank")
    return out.mapInPandas(place, PIECES + ", sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))
