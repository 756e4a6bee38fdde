"""BPE encoding and decoding by tree concatenation.

Long texts are cut in 2^k pieces of at most ``SPLIT`` characters, wherever the middle falls. Pieces are rows of their own, so
tasks encode them in parallel; then neighbours are joined, ``FAN`` in a task and level by level, so that only the last join
holds a whole document. At a join the text around the cut is encoded anew in a window that grows until both sides agree exactly:

* where the text has blanks, the window is the word that the cut went through, up to the blank on either side. The
  vocabulary drops blanks and never merges across them, so both sides agree from there on;
* where a run without blanks of more than ``LONG_WORD`` characters meets the cut, both its sides are encoded already, and the
  window takes 16, 32, 64... tokens from either side, until two successive tokens on each side are the same, at the same
  places, as in the window. A token sequence is what BPE gives if every adjacent pair is, so the spliced sequence is exact; if
  no window agrees, the whole run is encoded. A run inside a piece is encoded as a tree of halves in the same way.

A piece's words are encoded once each and remembered (a bounded table); words are independent of each other.

Edge cases: a null text is empty: 0 tokens and the digests of the empty string. Repeated rows, null ids and ties each give
their own equal rows. Extra columns are ignored. Very long texts with or without blanks take the paths above. Strings of
special tokens in a text become those tokens, as in the library. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT, LONG_WORD, LEAF, WORDS_KEPT, FAN = 65536, 4096, 4096, 500_000, 32
OUT = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"


_words: dict = {}


def words_for(path: str) -> Words:
    """One Words for each vocabulary and worker process: what it remembers outlives a task."""
    if path not in _words:
        _words[path] = Words(load(path))
    return _words[path]


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _plain(tok, text: str) -> tuple[list, list]:
    e = tok.encode(text, add_special_tokens=False)
    return e.ids, e.offsets


def _cuts(offsets: list) -> list:
    """Indices of tokens that begin where no token before them reaches."""
    out, end = [], -1
    for i, (a, b) in enumerate(offsets):
        if a >= end:
            out.append(i)
        end = max(end, b)
    return out


def _shared(a_ids, a_off, b_ids, b_off, side: str):
    """(i, j): tokens i, i+1 of a are tokens j, j+1 of b at the same places, with clear borders; the outermost pair."""
    at = {o: j for j, o in enumerate(b_off)}
    clear_a, clear_b = set(_cuts(a_off)), set(_cuts(b_off))
    order = range(len(a_ids) - 2) if side == "left" else range(len(a_ids) - 3, -1, -1)
    for i in order:
        j = at.get(a_off[i])
        if j is None or j + 2 >= len(b_ids) or i + 2 >= len(a_ids):
            continue
        if {i, i + 1, i + 2} <= clear_a and {j, j + 1, j + 2} <= clear_b and a_ids[i : i + 2] == b_ids[j : j + 2] and a_off[i + 1] == b_off[j + 1]:
            return i, j
    return None


def splice(tok, text: str, mid: int, left: tuple[list, list], right: tuple[list, list]) -> tuple[list, list]:
    """(ids, offsets) of text from those of its first ``mid`` characters and of the rest, both with offsets in the whole."""
    (left_ids, left_off), (right_ids, right_off) = left, right
    n = 16
    left_cuts, right_cuts = _cuts(left_off), _cuts(right_off)
    while n < len(left_cuts) and n < len(right_cuts):
        i0, j1 = left_cuts[-n], right_cuts[n]
        a, b = left_off[i0][0], right_off[j1][0]
        ids, off = _plain(tok, text[a:b])
        off = [(x + a, y + a) for x, y in off]
        l, r = _shared(left_ids[i0:], left_off[i0:], ids, off, "left"), _shared(right_ids[:j1], right_off[:j1], ids, off, "right")
        if l and r and l[1] + 1 < r[1] and off[l[1] + 1][1] <= mid <= off[r[1]][0]:
            i, j = i0 + l[0], r[0]
            return left_ids[: i + 1] + ids[l[1] + 1 : r[1] + 1] + right_ids[j + 1 :], left_off[: i + 1] + off[l[1] + 1 : r[1] + 1] + right_off[j + 1 :]
        n *= 2
    return _plain(tok, text)


def _moved(encoded: tuple[list, list], by: int) -> tuple[list, list]:
    return encoded[0], [(a + by, b + by) for a, b in encoded[1]]


def tree_ids(tok, text: str, leaf: int = LEAF) -> tuple[list, list]:
    """ids and character offsets of a text, encoded as a tree of halves."""
    if len(text) <= leaf:
        return _plain(tok, text)
    mid = len(text) // 2
    return splice(tok, text, mid, tree_ids(tok, text[:mid], leaf), _moved(tree_ids(tok, text[mid:], leaf), mid))


class Words:
    """Encodes the blank-separated words of a text; each word gives (ids, decoded text, count), ids and text ending in a space.

    Words that are not remembered are encoded together, as one text, and told apart by their places in it.
    """

    def __init__(self, tok, kept: int = WORDS_KEPT):
        self.tok, self.kept, self.memo = tok, kept, {"": ("", "", 0)}
        n = max(tok.get_vocab(with_added_tokens=True).values()) + 1
        self.number = [f"{i} " for i in range(n)]
        self.token = [f"{tok.decode([i], skip_special_tokens=False)} " for i in range(n)]

    def _row(self, ids: list) -> tuple:
        return "".join([self.number[i] for i in ids]), "".join([self.token[i] for i in ids]), len(ids)

    def learn(self, words: list) -> dict:
        """Rows of the words; short ones are remembered from now on."""
        found = {w: self._row(tree_ids(self.tok, w)[0]) for w in words if len(w) > LONG_WORD}
        short = [w for w in words if len(w) <= LONG_WORD]
        if len(self.memo) > self.kept:
            self.memo = {"": ("", "", 0)}
        if short:
            e = self.tok.encode(" ".join(short), add_special_tokens=False)
            ids, starts, row = e.ids, [a for a, _ in e.offsets], self._row
            at, to, i, n = 0, 0, 0, len(ids)
            for w in short:
                to += len(w) + 1
                while i < n and starts[i] < to:
                    i += 1
                found[w] = r = row(ids[at:i])
                at = i
                if len(w) <= 64:
                    self.memo[w] = r
        return found

    def __call__(self, words: list) -> tuple[str, str, int]:
        rows = list(map(self.memo.get, words))
        if None in rows:
            found = self.learn(list({w for w, r in zip(words, rows, strict=True) if r is None}))
            rows = [found[w] if r is None else r for w, r in zip(words, rows, strict=True)]
        return "".join([r[0] for r in rows]), "".join([r[1] for r in rows]), sum([r[2] for r in rows])

    def many(self, texts: list) -> list:
        """One result for each list of words; what is new in any of them is encoded at once."""
        new = set().union(*texts).difference(self.memo)
        if new:
            self.learn(list(new))
        return [self(t) for t in texts]


def words_of(text: str) -> list:
    return text.replace("\n", " ").split(" ")


def digest(ids: str, decoded: str) -> tuple[str, str]:
    return hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(decoded[:-1].encode()).hexdigest()


class Run:
    """Characters without a blank at an end of a piece; ids and offsets once there are more than ``LONG_WORD``."""

    __slots__ = ("text", "encoded")

    def __init__(self, text: str, encoded: tuple[list, list] | None = None):
        self.text, self.encoded = text, encoded

    @classmethod
    def of(cls, words: Words, text: str) -> Run:
        return cls(text, tree_ids(words.tok, text) if len(text) > LONG_WORD else None)

    def joined(self, words: Words, other: Run) -> Run:
        if not self.text or not other.text:
            return self if self.text else other
        text, mid = self.text + other.text, len(self.text)
        if len(text) <= LONG_WORD:
            return Run(text)
        left, right = (r.encoded or _plain(words.tok, r.text) for r in (self, other))
        return Run(text, splice(words.tok, text, mid, left, _moved(right, mid)))

    def row(self, words: Words) -> tuple[str, str, int]:
        return words._row(self.encoded[0]) if self.encoded else words([self.text])

    def packed(self) -> tuple[str, bytes | None]:
        return self.text, None if self.encoded is None else np.concatenate([self.encoded[0], np.array(self.encoded[1], dtype=np.int64).ravel()]).astype("<i4").tobytes()

    @classmethod
    def unpacked(cls, text: str, data: bytes | None) -> Run:
        if data is None:
            return cls(text)
        x = np.frombuffer(data, dtype="<i4")
        n = len(x) // 3
        return cls(text, (x[:n].tolist(), list(map(tuple, x[n:].reshape(n, 2).tolist()))))


def piece(words: Words, text: str) -> tuple:
    """(head, ids, decoded, n, tail): the whole words of a piece encoded, the runs at its ends; tail is None if no blank is inside."""
    w = words_of(text)
    return (Run.of(words, w[0]), *words(w[1:-1]), Run.of(words, w[-1])) if len(w) > 1 else (Run.of(words, w[0]), "", "", 0, None)


def join(words: Words, a: tuple, b: tuple) -> tuple:
    """Joins two neighbours: the run across the cut is made whole."""
    if a[4] is None:
        return (a[0].joined(words, b[0]), *b[1:])
    across = a[4].joined(words, b[0])
    if b[4] is None:
        return (*a[:4], across)
    ids, decoded, n = across.row(words)
    return a[0], a[1] + ids + b[1], a[2] + decoded + b[2], a[3] + n + b[3], b[4]


def join_all(words: Words, pieces: list) -> tuple:
    """One piece from neighbours, pair by pair."""
    while len(pieces) > 1:
        pieces = [join(words, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def finished(words: Words, one: tuple) -> tuple[str, str, int]:
    """(ids, decoded, n) of a piece that is a whole text."""
    head, ids, decoded, n, tail = one
    a, b = head.row(words), tail.row(words) if tail is not None else ("", "", 0)
    return a[0] + ids + b[0], a[1] + decoded + b[1], a[2] + n + b[2]


PIECE = "row string, doc_id string, i int, head string, head_ids binary, ids string, decoded string, n long, tail string, tail_ids binary"


def _frame(keys: list[tuple], made: list[tuple]) -> pd.DataFrame:
    rows = [(*k, *head.packed(), ids, decoded, n, *(tail.packed() if tail is not None else (None, None))) for k, (head, ids, decoded, n, tail) in zip(keys, made, strict=True)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])


def _pieces(pdf: pd.DataFrame) -> list[tuple]:
    none = lambda x: None if x is None or x is pd.NA or isinstance(x, float) else x
    tails = [None if none(t) is None else Run.unpacked(t, none(d)) for t, d in zip(pdf["tail"], pdf["tail_ids"], strict=True)]
    return [(Run.unpacked(h, none(d)), ids, decoded, n, tail) for h, d, ids, decoded, n, tail in zip(pdf["head"], pdf["head_ids"], pdf["ids"], pdf["decoded"], pdf["n"], tails, strict=True)]


def levels(split: int, fan: int) -> int:
    """Levels of joins that the longest string of Spark (2^31 bytes) needs."""
    n, pieces = 1, 2 ** max(0, math.ceil(math.log2(2**31 / split)))
    while fan**n < pieces:
        n += 1
    return n


def encode_documents(docs: DataFrame, tokenizer_path: str, split: int = SPLIT, fan: int = FAN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text.

    Texts of up to ``split`` characters are encoded where they are read, without a shuffle. The pieces of longer ones are
    dealt over tasks and meet again in groups of ``fan`` neighbours, level by level.
    """
    # Ids go through Python as text, since nulls would turn longs into doubles.
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_for(tokenizer_path)
        for pdf in batches:
            rows, texts = [], pdf["text"].tolist()
            for i in range(0, len(texts), 128):
                rows += [(n, *digest(ids, decoded)) for ids, decoded, n in words.many([words_of(t) for t in texts[i : i + 128]])]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_for(tokenizer_path)
        for pdf in batches:
            yield _frame(list(zip(pdf["row"], pdf["doc_id"], pdf["i"], strict=True)), [piece(words, t) for t in pdf["text"]])

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        words = words_for(tokenizer_path)
        pdf = pdf.sort_values("i")
        return _frame([(pdf["row"].iloc[0], pdf["doc_id"].iloc[0], pdf["i"].iloc[0] // fan)], [join_all(words, _pieces(pdf))])

    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_for(tokenizer_path)
        for pdf in batches:
            done = [finished(words, p) for p in _pieces(pdf)]
            yield pd.DataFrame([(i, n, *digest(ids, decoded)) for i, (ids, decoded, n) in zip(pdf["doc_id"], done, strict=True)], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    short = docs.filter(F.length("text") <= split).mapInPandas(whole, OUT)
    long = docs.filter(F.length("text") > split)
    # Halves of halves: 2^k pieces of at most `split` characters.
    k = F.pow(F.lit(2), F.ceil(F.log2(F.length("text") / split))).cast("int")
    cut = lambda i: F.floor(F.length("text").cast("long") * i / F.col("k")).cast("int")
    long = long.withColumn("k", k).withColumn("row", F.expr("uuid()"))
    pieces = long.select("row", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(i.alias("i"), F.substring("text", cut(i) + 1, cut(i + 1) - cut(i)).alias("text")))).alias("p")).select("row", "doc_id", "p.i", "p.text")
    encoded = pieces.repartition("row", "i").mapInPandas(parts, PIECE)
    for _ in range(levels(split, fan)):
        encoded = encoded.groupBy("row", F.floor(F.col("i") / fan)).applyInPandas(level, PIECE)
    return short.union(encoded.mapInPandas(ended, OUT)).withColumn("doc_id", F.col("doc_id").cast("long"))
