"""LM scoring with a hashed maximum-entropy model.

A token's probability is P(class | context) * P(slot | class, previous token) * P(token | slot). Classes come from a token's
last two bytes. A slot is one of the commonest training tokens (the head) or a part of the rest of a class, by the token's
hash; inside a rest a token has its add-one share, with one share for unknown tokens. P(class | context) is a softmax over
hashed features: the previous token, the two before together, and a skip over the previous one. Features are hashes of the
tokens' own hashes, so every token takes part as context, whether it is in the head or not. It is trained by
rounds of distributed gradient updates: in a round every task runs adaptive gradient steps over its part of that round's
documents from the same weights, and the weights become the mean over tasks, each feature weighted by how often a task saw it.
P(slot | class, previous) is a maximum-entropy model with hashed previous-token features; its gradient needs only counts of
(hashed previous token, slot), which are summed over the corpus.

The model follows the corpus (``sizes_for``): feature tables grow with the training tokens, the head with their root, the parts
of a rest with the vocabulary, up to documented bounds that keep the broadcast weights within memory.

Tokens of about ``BLOCK`` characters of text form a block with a vocabulary of its own; documents become numbers in it. A token
is named by its 64-bit hash. Counts are summed by token over the blocks' vocabularies and return to the blocks, so no task and
no driver holds the whole vocabulary, and the commonest token has one row for each block.

Ids go through Python as text, since nulls would turn longs into doubles.

Edge cases: a null text is empty; an empty text is one end token. A null doc_id counts as the empty text in the crc32.
Repeated rows are documents of their own. Ties for the head go to the smaller hash. Extra columns are ignored. With no
training documents every token is unknown, N is 0 and probabilities are uniform over slots. An empty table gives an empty
result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, one_thread

CLASSES, KINDS, SLOT_CONTEXTS, ROUNDS, STEP, FOLDS, HELD_OUT, BLOCK = 16, 3, 256, 4, 32768, 7, 2, 16_000_000
#: Bounds of the model's sizes: features of a kind, head, parts of a rest.
FEATURES, HEAD, PARTS = (2**13, 2**16), (2048, 4096), (8, 64)
END = b""
RATE, SLICE = 0.25, 50_000


class Sizes:
    """Features of a kind, head, parts of each class's rest; all powers of two."""

    def __init__(self, features: int, head: int, parts: int):
        self.features, self.head, self.parts = features, head, parts

    @property
    def letters(self) -> int:
        """Number of slots."""
        return self.head + CLASSES * self.parts


def sizes_for(n_tokens: int, n_distinct: int) -> Sizes:
    """Sizes for a training corpus: a feature for 4096 tokens, a head of a quarter of their root, a part for 2^17 distinct ones."""
    power = lambda x, bounds: min(max(1 << max(0, int(x).bit_length() - 1), bounds[0]), bounds[1])
    return Sizes(power(n_tokens // 4096, FEATURES), power(n_tokens**0.5 / 4, HEAD), power(n_distinct // 2**17, PARTS))


def tokens(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII blanks, then the end."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def class_of(words: list[bytes]) -> np.ndarray:
    """The end has a class of its own; other tokens go by their last two bytes."""
    two = np.array([int.from_bytes(w[-2:], "little") if w else 0 for w in words], dtype=np.uint32)
    h = (two * np.uint32(2654435761)) >> np.uint32(16)
    return np.where(two == 0, CLASSES - 1, h % np.uint32(CLASSES - 1)).astype(np.int32)


def contexts(hashes: np.ndarray, begin: np.ndarray, features: int) -> tuple[np.ndarray, ...]:
    """Feature numbers of each position: previous, two previous, skip of one. hashes: sixteen bits each; begin: places where texts begin."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(begin, np.diff([*begin, n]))
    # Zero stands before a text.
    a, b = (np.where(place >= k, np.concatenate([np.zeros(min(k, n), dtype=np.uint32), hashes[: max(0, n - k)]]), np.uint32(0)) for k in (1, 2))
    shift = np.uint32(33 - features.bit_length())
    with np.errstate(over="ignore"):
        one, skip = a * np.uint32(2654435769), b * np.uint32(2654435769)
        both = (one ^ (skip >> np.uint32(7)) ^ (b << np.uint32(16))) * np.uint32(2246822519)
    return tuple((x >> shift).astype(np.uint16) for x in (one, both, skip))  # sixteen bits sort fastest


class Weights:
    """Of the class model: one table for each kind of feature, and a bias."""

    def __init__(self, counts: np.ndarray, features: int):
        p = (counts + 1.0) / (counts.sum() + len(counts))
        self.bias = np.log(p).astype(np.float32)
        self.tables = [np.zeros((features, CLASSES), dtype=np.float32) for _ in range(KINDS)]

    def _scores(self, features: tuple) -> np.ndarray:
        z = self.tables[0].take(features[0], axis=0)
        z += self.bias
        for t, f in zip(self.tables[1:], features[1:], strict=True):
            z += t.take(f, axis=0)
        return z

    def log_p(self, features: tuple) -> np.ndarray:
        z = self._scores(features)
        # Weights are bounded, so the exponentials are finite without taking the largest out.
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def log_p_of(self, features: tuple, target: np.ndarray) -> np.ndarray:
        """log P of one class at each position."""
        z = self._scores(features)
        own = z[np.arange(len(target)), target]
        return own - np.log(np.exp(z, out=z).sum(axis=1))

    def learn(self, features: tuple, target: np.ndarray, squares: list, rate: float = RATE) -> None:
        """One adaptive gradient step over a batch."""
        g = self._scores(features)
        np.exp(g, out=g)
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(target)), target] -= 1
        for t, f, s in zip(self.tables, features, squares, strict=True):
            order = np.argsort(f, kind="stable")
            in_order = f.take(order)
            starts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
            rows, n = in_order[starts], np.diff(np.append(starts, len(f))).astype(np.float32)
            total = np.add.reduceat(g.take(order, axis=0), starts, axis=0)
            total /= np.sqrt(n)[:, None]
            own = s[rows] + total * total
            s[rows] = own
            t[rows] = np.clip(t[rows] - rate * total / np.sqrt(own + np.float32(1e-2)), -15, 15)


def slot_classes(head: list[int], sizes: Sizes) -> np.ndarray:
    """Class of each slot, from those of the head's tokens; -1 for places of the head that are not taken."""
    return np.concatenate([np.array(head, dtype=np.int32), np.full(sizes.head - len(head), -1, dtype=np.int32), np.repeat(np.arange(CLASSES, dtype=np.int32), sizes.parts)])


def slot_context(previous: np.ndarray) -> np.ndarray:
    """Of the hash of the token before."""
    with np.errstate(over="ignore"):
        return ((previous.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(24)).astype(np.int64) % SLOT_CONTEXTS


def before(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of the token before each position, zero where a text begins."""
    out = np.concatenate([np.zeros(1, dtype=hashes.dtype), hashes[:-1]])
    out[begin] = 0
    return out


def fit_slots(counts: np.ndarray, classes: np.ndarray, rounds: int = 40) -> np.ndarray:
    """log P(slot | class, context) for counts (contexts, slots): softmax inside each class over a bias and a context weight, by gradient steps on the summed counts."""
    used = classes >= 0
    order = np.argsort(classes, kind="stable")
    order = order[used[order]]
    c = classes[order]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    group = np.cumsum(np.concatenate([[0], (c[1:] != c[:-1]).astype(int)]))
    x = counts[:, order].astype(np.float64)
    total = np.add.reduceat(x, starts, axis=1)[:, group]
    bias = np.log(x.sum(axis=0) + 1.0)
    w = np.zeros_like(x)

    def log_p() -> np.ndarray:
        z = w + bias
        z -= np.maximum.reduceat(z, starts, axis=1)[:, group]
        return z - np.log(np.add.reduceat(np.exp(z), starts, axis=1))[:, group]

    for _ in range(rounds):
        p = np.exp(log_p())
        w += (x - total * p - 0.5 * w) / (total * p * (1 - p) + 2.0) * 0.5
        np.clip(w, -12, 12, out=w)
    out = np.full(counts.shape, -np.inf)
    out[:, order] = log_p()
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """Lower halves, then upper halves, which are nearly all zero and compress to little."""
    return numbers.astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()


def _whole(planes: bytes) -> np.ndarray:
    low, high = np.frombuffer(planes, dtype="<u2").reshape(2, -1)
    return low | (high.astype(np.int32) << 16)


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents as numbers in a block's vocabulary, and the vocabularies: block, hash, class, number, n | block, doc_id, held_out, ids."""
    schema = "block long, hash long, class int, number int, n long, doc_id string, held_out boolean, ids binary"

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        def written():
            """The block's rows, some at a time: numbers are renewed in the order of counts, so common tokens have small ones."""
            block = int.from_bytes(os.urandom(8), "little") >> 1
            words = list(vocabulary)
            vocabulary.clear()
            flat = np.concatenate([r[2] for r in rows])
            held = np.repeat([r[1] for r in rows], [len(r[2]) for r in rows])
            all_n, train = np.bincount(flat, minlength=len(words)), np.bincount(flat[~held], minlength=len(words))
            order = np.argsort(-all_n, kind="stable")
            rank = np.empty(len(words), dtype=np.int32)
            rank[order] = np.arange(len(words))
            del flat, held, all_n, order
            for i in range(0, len(words), SLICE):
                some = words[i : i + SLICE]
                n = len(some)
                h = np.array(list(map(digest, some)), dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"block": block, "hash": h, "class": class_of(some), "number": rank[i : i + n], "n": train[i : i + n], "doc_id": None, "held_out": pd.array([pd.NA] * n, dtype="boolean"), "ids": None})
            for i in range(0, len(rows), 1000):
                some = rows[i : i + 1000]
                none = pd.array([pd.NA] * len(some), dtype="Int64")
                yield pd.DataFrame({"block": block, "hash": none, "class": none, "number": none, "n": none, "doc_id": [r[0] for r in some], "held_out": pd.array([r[1] for r in some], dtype="boolean"), "ids": [_planes(rank[r[2]]) for r in some]})

        vocabulary: dict = {}
        rows, size = [], 0
        for pdf in batches:
            for doc_id, held, text in zip(pdf["doc_id"], pdf["held_out"], pdf["text"], strict=True):
                t = tokens(text)
                for w in set(t).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                rows.append((doc_id, bool(held), np.array(list(map(vocabulary.__getitem__, t)), dtype=np.int32)))
                size += len(text or "") + 1
                if size > BLOCK:
                    yield from written()
                    rows, size = [], 0
        if rows:
            yield from written()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")).mapInPandas(number, schema)


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    blocks = scratch.table(_blocks(docs), "blocks")
    by = Window.partitionBy("hash")
    words = blocks.filter("hash is not null").select("block", "number", "class", "hash", F.sum("n").over(by).alias("c"), (F.row_number().over(by.orderBy("block")) == 1).alias("lead"))
    words = scratch.table(words, "words")
    seen = words.filter("lead and c > 0")
    total, distinct = (int(x or 0) for x in seen.agg(F.sum("c"), F.count(F.lit(1))).first())
    sizes = sizes_for(total, distinct)
    head = seen.orderBy(F.desc("c"), "hash").limit(sizes.head).collect()  # a bounded number
    classes = slot_classes([r["class"] for r in head], sizes)
    rest = sizes.head + F.col("class") * sizes.parts + F.pmod("hash", F.lit(sizes.parts))
    slot_n, slot_v = np.zeros(sizes.letters, dtype=np.int64), np.zeros(sizes.letters, dtype=np.int64)
    for r in seen.groupBy(rest.alias("slot")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # one row a slot
        slot_n[r["slot"]], slot_v[r["slot"]] = r["c"], r["v"]
    for i, r in enumerate(head):
        own = sizes.head + r["class"] * sizes.parts + r["hash"] % sizes.parts
        slot_n[own], slot_v[own], slot_n[i], slot_v[i] = slot_n[own] - r["c"], slot_v[own] - 1, r["c"], 1
    # One long for a vocabulary's row: slot, hash, number.
    packed = F.shiftleft(F.coalesce("place", rest).cast("long"), 47).bitwiseOR(F.shiftleft(F.col("hash").bitwiseAND(65535).bitwiseOR(1), 31)).bitwiseOR(F.col("number").cast("long"))
    places = spark.createDataFrame([(r["hash"], i) for i, r in enumerate(head)], "hash long, place int")
    # The head is of bounded size. Sixteen bits of a token's hash, never zero, are its part in features.
    known = words.join(F.broadcast(places), "hash", "left").select("block", "c", packed.alias("packed"))

    def coded(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p = left["packed"].to_numpy()
        at = p & 0x7FFFFFFF
        c, slot, h = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int16), np.zeros(len(left), dtype=np.uint16)
        c[at], slot[at], h[at] = left["c"].to_numpy(), p >> 47, (p >> 31) & 65535
        base = np.log10((c + 1) / (total + distinct + 1))
        inside = np.where(slot >= sizes.head, np.log10((c + 1) / (slot_n + slot_v + 1)[slot]), 0.0)
        rows = []
        for ids in right["ids"]:
            ids = _whole(ids)
            rows.append((len(ids), int((c[ids] > 0).sum()), base[ids].sum(), inside[ids].sum(), slot[ids].tobytes(), h[ids].tobytes()))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "inside", "slots", "hashes"])
        out.insert(0, "doc_id", right["doc_id"].to_numpy())
        out.insert(1, "held_out", right["held_out"].to_numpy())
        return out.astype({"held_out": "bool"})

    coded_schema = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, inside double, slots binary, hashes binary"
    texts = blocks.filter("ids is not null").select(F.col("block").alias("text_block"), "doc_id", "held_out", "ids")
    made = known.groupBy("block").cogroup(texts.groupBy("text_block")).applyInPandas(coded, coded_schema)
    turn = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(rounds))).cast("int")
    # A round reads its own folder only.
    data = scratch.table(made.withColumn("round", turn), "coded", by="round")
    scratch.drop(blocks, words)
    weights, log_slots = train(data, slot_n, classes, sizes, rounds)
    sent = spark.sparkContext.broadcast((weights, (log_slots / np.log(10)).astype(np.float32)))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        weights, slot_p = sent.value
        for pdf in batches:
            parts = []
            for a in range(0, len(pdf), 256):
                flat, h, begin = _texts(pdf["slots"].iloc[a : a + 256], pdf["hashes"].iloc[a : a + 256])
                p = np.empty(len(flat))
                f, context = contexts(h, begin, sizes.features), slot_context(before(h, begin))
                for i in range(0, len(flat), STEP):
                    own = tuple(x[i : i + STEP] for x in f)
                    s = flat[i : i + STEP]
                    p[i : i + STEP] = weights.log_p_of(own, classes[s]) / np.log(10) + slot_p[context[i : i + STEP], s]
                parts.append(np.add.reduceat(p, begin))
            out = pdf[["doc_id", "held_out", "n_tokens", "n_known", "base_score"]].copy()
            out["train_tokens"] = total
            out["score"] = (np.concatenate(parts) if parts else np.zeros(0)) + pdf["inside"].to_numpy()
            yield out

    out = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double"
    return data.mapInPandas(scored, out).select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _texts(slots, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and hashes of several texts in a row, and where each begins."""
    some = [np.frombuffer(s, dtype=np.int16) for s in slots]
    return np.concatenate(some), np.frombuffer(b"".join(hashes), dtype=np.uint16), np.cumsum([0, *map(len, some)])[:-1]


def train(data: DataFrame, slot_n: np.ndarray, classes: np.ndarray, sizes: Sizes, rounds: int = ROUNDS) -> tuple[Weights, np.ndarray]:
    """The class model's weights and log P(slot | class, context) from the rows of data; held-out ones have the round -1."""
    spark = data.sparkSession
    learning = data.filter("round >= 0").select("slots", "hashes", "round")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOT_CONTEXTS * sizes.letters, dtype=np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                flat, h, begin = _texts(pdf["slots"].iloc[a : a + 1024], pdf["hashes"].iloc[a : a + 1024])
                n += np.bincount(slot_context(before(h, begin)) * sizes.letters + flat, minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"cell": at, "n": n[at]})

    counts = np.zeros(SLOT_CONTEXTS * sizes.letters)
    summed = learning.select("slots", "hashes").mapInPandas(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # a bounded number of cells
    counts[summed["cell"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy()
    log_slots = fit_slots(counts.reshape(SLOT_CONTEXTS, sizes.letters), classes)
    by_class = np.bincount(classes[classes >= 0], weights=slot_n[classes >= 0], minlength=CLASSES)
    weights = Weights(by_class, sizes.features)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def updates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one_thread()
            own = Weights(by_class, sizes.features)
            own.tables = [t.copy() for t in sent.value.tables]
            squares = [np.zeros_like(t) for t in own.tables]
            seen = [np.zeros(sizes.features, dtype=np.float64) for _ in range(KINDS)]
            some, size = [], 0

            def step() -> None:
                flat, h, begin = _texts(*zip(*some, strict=True))
                f, target = contexts(h, begin, sizes.features), classes[flat]
                for i in range(0, len(flat), STEP):
                    part = tuple(x[i : i + STEP] for x in f)
                    own.learn(part, target[i : i + STEP], squares)
                for n, x in zip(seen, f, strict=True):
                    n += np.bincount(x, minlength=len(n))

            for pdf in batches:
                for s in zip(pdf["slots"], pdf["hashes"], strict=True):
                    some.append(s)
                    size += len(s[0]) // 2
                    if size >= 8 * STEP:
                        step()
                        some, size = [], 0
            if some:
                step()
            base = np.arange(KINDS + 1) * sizes.features
            for b, t, old, n in zip(base, own.tables, sent.value.tables, seen, strict=False):
                at = np.flatnonzero(n)
                if not len(at):
                    continue
                yield pd.DataFrame({"feature": at + b, "n": n[at], "change": list((t[at] - old[at]) * n[at, None].astype(np.float32))})

        part = learning.filter(F.col("round") == k).mapInPandas(updates, "feature long, n double, change array<float>")
        sums = [(F.sum(F.get("change", F.lit(c))) / F.sum("n")).cast("float").alias(f"c{c}") for c in range(CLASSES)]
        got = part.groupBy("feature").agg(*sums).toPandas()  # at most one row a feature
        change = got[[f"c{c}" for c in range(CLASSES)]].to_numpy()
        base = np.arange(KINDS + 1) * sizes.features
        new = Weights(by_class, sizes.features)
        new.tables = [t.copy() for t in weights.tables]
        feature = got["feature"].to_numpy(dtype=np.int64)
        for i, t in enumerate(new.tables):
            own = (feature >= base[i]) & (feature < base[i + 1])
            t[feature[own] - base[i]] += change[own]
        weights = new
    return weights, log_slots
