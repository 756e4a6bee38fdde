"""Substring dedup by hashing runs of words that content alone delimits.

A text is cut after words. A line end is the best place, then ``.``, ``!`` or ``?`` before a blank, then any word, the smaller
hash first. A word is a cut when no word up to ``MIN_WORDS`` - 1 away, or up to ``NEAR`` away for a word inside a sentence, is a
better place. So a cut depends on the words close to it and not on where the line, the sentence or the text began: a passage is
cut at the same words wherever it stands, short lines are joined until they hold ``MIN_WORDS`` words, and a sentence glued to
other words is cut as it is alone. Runs without a cut, such as one word again and again, that are longer than ``LONG_WORDS``
words are cut every ``RUN`` words. In scripts written without blanks a few letters count as a word (see ``pieces``).

Units are normalised (lower case, single blanks) and units of at least ``MIN_WORDS`` words get a 128-bit digest. Digests are
grouped over all documents; the occurrence that is first by (doc_id, row hash, place) stays and the others are repeats. Shorter
units are found only where a text begins or ends and next to the runs; one counts as a repeat when both its neighbours do.
Neighbouring repeats make a passage. A passage of at least ``MIN_RUN`` words goes, with the original offsets retained; a shorter
one stays, since sentences of a few words recur in texts that have nothing else in common (``least_run=1`` removes them too).

The grouping is pre-aggregated before its shuffle, and the occurrences meet their digest's first one in a join of two
written tables, where Spark splits the partition of a hot line.

Edge cases: a null text stays null and an empty one empty; neither has units. Rows that repeat (doc_id, text) are the same
document and lose the same units. A null doc_id ranks first. A digest's ties cannot be: rank and place are unique for a
document. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, row_key

MIN_WORDS, LONG_WORDS, NEAR, RUN, MIN_RUN = 5, 32, 5, 12, 20
PIECE = re.compile(r"\S+\s*")
#: Thai to Khmer, kana, Han and compatibility forms: letters that no blanks divide into words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
STOPS = frozenset(".!?\u3002\uff01\uff1f")
hashes = cache(WordHashes)


def pieces(text: str) -> list[str]:
    """Words with the blanks behind them. Letters of ``UNSPACED`` end a word when their code is even, and so do full stops after them."""
    found = PIECE.findall(text)
    if text.isascii() or not UNSPACED.search(text):
        return found
    out = []
    for p in found:
        begin = 0
        n = len(p.rstrip())
        for i in range(n - 1):
            if (UNSPACED.match(p[i]) and ord(p[i]) % 2 == 0 and p[i + 1] not in STOPS) or (ord(p[i]) > 127 and p[i] in STOPS):
                out.append(p[begin : i + 1])
                begin = i + 1
        out.append(p[begin:])
    return out


def size(words: list[str], least: int = MIN_WORDS) -> int:
    """Number of words, at least ``least`` or exact; parts of words without blanks count."""
    return len(words) if len(words) >= least else sum(len(pieces(w)) for w in words)


def units(text: str, least: int = MIN_WORDS) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of the units, in characters; together they are the whole text."""
    if not text:
        return []
    found = pieces(text)
    if not found:
        return [(0, len(text), [])]
    words = text.lower().split()
    spaced = len(words) == len(found)
    at = cuts(found, words if spaced else [p.rstrip().lower() for p in found], least)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = len(text) - lengths.sum() + np.cumsum(lengths)
    out: list[tuple[int, int, list[str]]] = []
    start = first = 0
    for i in at:
        p, n = found[i], len(found[i].rstrip())
        end = int(ends[i]) - len(p) + max(n, p.rfind("\n") + 1)
        out.append((start, end, words[first : i + 1] if spaced else text[start:end].lower().split()))
        start, first = end, i + 1
    if start < len(text):
        out.append((start, len(text), words[first:] if spaced else text[start:].lower().split()))
    return out


def cuts(found: list[str], words: list[str], least: int) -> list[int]:
    """Numbers of the words after which a text is cut, but for the last."""
    n = len(words)
    rank = np.array([0 if "\n" in p else 1 if w[-1] in STOPS else 2 for p, w in zip(found, words, strict=True)], dtype=np.uint64)
    # Full stops and line ends come first; equal words count as a worse place than the first of them.
    key = (rank << np.uint64(62)) | (hashes()(words) >> np.uint64(2))
    best = np.ones(n, dtype=bool)
    inside = rank == 2
    for d in range(1, min(max(least - 1, NEAR), n - 1) + 1):
        ahead, behind = key[:-d] <= key[d:], key[d:] < key[:-d]
        if d >= least:
            ahead, behind = ahead | ~inside[:-d], behind | ~inside[d:]
        best[:-d] &= ahead
        best[d:] &= behind
    best[-1] = False
    out, last = [], -1
    for i in [*np.flatnonzero(best).tolist(), n - 1]:
        if i - last > LONG_WORDS:
            out += range(last + RUN, i - RUN + 1, RUN)
        out.append(i)
        last = i
    return out[:-1]


def removed_spans(spans: list, gone: set, least: int = MIN_WORDS, least_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Merged (start, end) of the units in ``gone`` and of short ones between two of them, where they hold ``least_run`` words."""
    out: list[list[int]] = []
    for i, (a, b, words) in enumerate(spans):
        if i in gone or (size(words, least) < least and i - 1 in gone and i + 1 in gone):
            n = size(words, least_run)
            if out and out[-1][1] == a:
                out[-1][1] = b
                out[-1][2] += n
            else:
                out.append([a, b, n])
    return [(a, b) for a, b, n in out if n >= least_run]


def unit_digests(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """d1, d2, doc_id, row, place of every unit of at least ``least`` words."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for pdf in batches:
            texts, ids, rows = pdf["text"].tolist(), pdf["doc_id"].to_numpy(), pdf["row"].to_numpy()
            for i in range(0, len(texts), 500):
                found, place, owner = [], [], []
                for j, t in enumerate(texts[i : i + 500], i):
                    at = 0
                    if not t:
                        continue
                    for k, (_, _, w) in enumerate(units(t, least)):
                        if size(w, least) >= least:
                            found.append(digest(" ".join(w).encode()))
                            place.append(k)
                            at += 1
                    owner += [j] * at
                d = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                yield pd.DataFrame({"d1": d[:, 0], "d2": d[:, 1], "doc_id": ids[np.array(owner, dtype=int)], "row": rows[np.array(owner, dtype=int)], "place": np.array(place, dtype=np.int32)})

    return docs.select("doc_id", "row", "text").mapInPandas(digests, "d1 long, d2 long, doc_id long, row long, place int")


def dedup(docs: DataFrame, least: int = MIN_WORDS, removed: str | None = "removed", least_run: int = MIN_RUN) -> DataFrame:
    """All columns of docs with ``text`` shortened, and ``removed``: array of (start, end) in characters of the old text.

    A column of docs with the name ``removed`` gives way to it; None adds nothing.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    names = docs.columns
    # Nulls would turn longs into doubles in Python; the row hash tells a null id from the smallest long.
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), rank.alias("doc_id"), F.col("text"), row_key(docs, "doc_id", "text").alias("row"))
    found = scratch.table(unit_digests(keyed, least), "units")
    at = F.struct("doc_id", "row", "place")
    first = found.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1", "d2", "first")
    first = scratch.table(first, "first")
    later = found.join(first, ["d1", "d2"]).filter(at > F.col("first"))
    gone = scratch.table(later.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("place")).alias("gone")), "gone")
    scratch.drop(found, first)
    # The row hash covers the id: equal ids with equal texts are one document here.
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "gone")
    out = keyed.join(gone, (F.col("row") == F.col("gone_row")) & (F.col("doc_id") == F.col("gone_id")), "left").select("doc", "text", "gone")

    @F.pandas_udf("struct<text:string,removed:array<struct<start:int,end:int>>>")
    def shorten(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g in zip(texts, gone, strict=True):
            if t is None or g is None:
                rows.append((t, []))
                continue
            cut = removed_spans(units(t, least), set(g.tolist()), least, least_run)
            kept = [t[a:b] for a, b in zip([0, *[b for _, b in cut]], [*[a for a, _ in cut], len(t)], strict=True)]
            rows.append(("".join(kept), [{"start": a, "end": b} for a, b in cut]))
        return pd.DataFrame(rows, columns=["text", "removed"])

    out = out.withColumn("new", shorten("text", "gone"))
    return out.select(*[(F.col("new.text") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in names if c != removed], *([F.col("new.removed").alias(removed)] if removed else []))
