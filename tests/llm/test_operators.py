"""Each operator against brute force, and its edge cases."""

import glob
import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docwright.llm import ann, bpe_tree, chat, common, jaccard, lm_scoring, packing, quality, queries, substring, url_filter, vector_dedup
from docwright.llm.components import components

DOCS = "doc_id long, text string, row string, score double, n int, removed string, label int"
VECTORS = "vec_id long, embedding array<float>, label int, key string, count int"
BIG = 2**60 + 1


def documents(spark, texts):
    """Texts with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "r", 0.5, 1, "x", 7) for i, t in texts], DOCS)


def prose(seed, n, vocabulary=200):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def odd_texts():
    base = [prose(i, 60) for i in range(12)]
    return [(None, "null id text of five words or more"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "three short words"), (BIG, base[0]), (BIG + 1, base[0]), (BIG, base[0]), (7, "x" * 30000), (8, base[1] + " " + "word " * 20000), *[(20 + i, t) for i, t in enumerate(base)], (40, base[2] + " tail"), (41, base[2])]


def test_lm_scoring(spark):
    texts = [*odd_texts(), *[(100 + i, prose(i % 9, 80)) for i in range(60)]]
    out = lm_scoring.score(documents(spark, texts))
    got = sorted(map(tuple, out.collect()), key=repr)
    crc = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7
    counts = Counter()
    for i, t in texts:
        if crc(i) != 2:
            counts.update(lm_scoring.tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in texts:
        w = lm_scoring.tokens(t)
        want.append((i, crc(i) == 2, len(w), sum(counts[x] > 0 for x in w), n, sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    want.sort(key=repr)
    assert [r[:5] for r in sorted((x[:5] for x in got), key=repr)] == sorted((x[:5] for x in want), key=repr)
    assert np.allclose(sorted(x[5] for x in got), sorted(x[5] for x in want))
    held = [x for x in got if x[1]]
    assert sum(x[6] for x in held) > sum(x[5] for x in held)
    assert all(np.isfinite(x[6]) and x[6] < 0 for x in got)


def test_lm_score_by_brute_force(spark, monkeypatch):
    """Each token's three factors one by one, from the trained weights and counts of the corpus."""
    import xxhash

    texts = [(None, None), (1, ""), (2, "one"), *[(10 + i, prose(i % 9, 40)) for i in range(40)]]
    sizes = lm_scoring.Sizes(2**13, 64, 4)
    monkeypatch.setattr(lm_scoring, "sizes_for", lambda n, v: sizes)
    kept, original = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: (kept.append(original(*a)), kept[0])[1])
    got = sorted(((r["doc_id"], r["score"]) for r in lm_scoring.score(documents(spark, texts)).collect()), key=repr)
    weights, log_slots = kept[0]
    counts = Counter()
    for i, t in texts:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update(lm_scoring.tokens(t))
    hashed = lambda w: int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64))
    head = sorted(counts, key=lambda w: (-counts[w], hashed(w)))[:64]
    kind = lambda w: int(lm_scoring.class_of([w])[0])
    slot = lambda w: head.index(w) if w in head else 64 + kind(w) * 4 + hashed(w) % 4
    rest = [w for w in counts if w not in head]
    want = []
    for i, t in texts:
        total, h = 0.0, [hashed(w) & 65535 | 1 for w in lm_scoring.tokens(t)]
        features = lm_scoring.contexts(np.array(h, dtype=np.uint16), np.array([0]), sizes.features)
        for k, w in enumerate(lm_scoring.tokens(t)):
            z = weights.bias.astype(float) + sum(table[f[k]] for table, f in zip(weights.tables, features, strict=True))
            total += (z[kind(w)] - np.log(np.exp(z).sum())) / np.log(10)
            previous = lm_scoring.slot_context(np.array([h[k - 1] if k else 0], dtype=np.uint16))[0]
            total += log_slots[previous, slot(w)] / np.log(10)
            if w not in head:
                same = [x for x in rest if slot(x) == slot(w)]
                total += np.log10((counts[w] + 1) / (sum(counts[x] for x in same) + len(same) + 1))
        want.append((i, total))
    for (i, x), (j, y) in zip(got, sorted(want, key=repr), strict=True):
        assert i == j and abs(x - y) < 1e-3 * max(1, abs(y))


def test_lm_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    sizes = lm_scoring.Sizes(2**13, 64, 4)
    w = lm_scoring.Weights(r.integers(0, 50, lm_scoring.CLASSES).astype(float), sizes.features)
    w.tables = [r.standard_normal(t.shape).astype(np.float32) for t in w.tables]
    f = tuple(r.integers(0, sizes.features, 10) for _ in range(lm_scoring.KINDS))
    assert np.allclose(np.exp(w.log_p(f)).sum(axis=1), 1, atol=1e-5)
    classes = lm_scoring.slot_classes([3, 7, 3], sizes)
    p = np.exp(lm_scoring.fit_slots(r.integers(0, 9, (lm_scoring.SLOT_CONTEXTS, sizes.letters)).astype(float), classes))
    for c in range(lm_scoring.CLASSES):
        assert np.allclose(p[:, classes == c].sum(axis=1), 1)


def test_lm_model_follows_the_corpus():
    small, large = lm_scoring.sizes_for(10**7, 10**5), lm_scoring.sizes_for(10**9, 10**7)
    assert large.features > small.features and large.head > small.head and large.parts > small.parts
    assert large.letters < 2**15


def test_lm_empty(spark):
    assert lm_scoring.score(documents(spark, [])).count() == 0


def odd_vectors(r, n=400, d=16):
    x = r.standard_normal((n, d)).astype(np.float32)
    x[50:60] = x[50] + 0.001 * r.standard_normal((10, d))
    x[70:80] = x[70]
    rows = [(int(i), x[i].tolist(), int(i % 3) if not 50 <= i < 80 else 1, "k", 0) for i in range(n)]
    rows += [(None, x[0].tolist(), 1, "k", 0), (1000, None, 1, "k", 0), (1020, [0.0] * d, 1, "k", 0), (1040, [float("nan")] * d, 1, "k", 0), (1060, [None, *[1.0] * (d - 1)], 1, "k", 0), (1080, [1.0], 1, "k", 0), (1100, [float("inf"), *[1.0] * (d - 1)], 1, "k", 0), (1120, x[71].tolist(), None, "k", 0), rows[70]]
    return rows


def good(v, d=16):
    return v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_ann(spark):
    rows = odd_vectors(np.random.default_rng(1))
    df = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, shard=150, queries=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    x = {i: np.array(v, dtype=np.float64) for i, v, *_ in rows if i is not None and good(v)}
    asked = [i for i in x if i % 20 == 0]
    assert set(got) == set(asked)
    found = 0
    for q in asked:
        best = sorted((-float(np.einsum("j,j->", x[i], x[q])), i) for i in x if i != q)[:20]
        found += len({i for i, *_ in got[q]} & {i for _, i in best})
        assert [r for *_, r in got[q]] == list(range(1, 21))
        assert [(-s, i) for i, s, _ in got[q]] == sorted((-s, i) for i, s, _ in got[q])
        assert all(abs(s - float(x[i] @ x[q])) < 1e-12 for i, s, _ in got[q])
    assert found / (20 * len(asked)) >= 0.9
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "k", 0), (1, [0.5, 0.0], 1, "k", 0)], VECTORS)
    assert [tuple(r) for r in ann.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]


@pytest.mark.parametrize("near", [False, True])
def test_ann_recall(spark, near):
    """Ten thousand vectors: without structure (codes are scanned) and in tight groups (tables are joined)."""
    r = np.random.default_rng(3)
    x = r.standard_normal((10_000, 32))
    if near:
        x = np.repeat(x[:200], 50, axis=0) + 0.08 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[5000:7000] = x[5000]
    df = spark.createDataFrame([(i, v.tolist(), 0, "k", 0) for i, v in enumerate(x)], VECTORS)
    planned = []
    original = ann._by_tables
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ann, "_by_tables", lambda *a: (planned.append(original(*a)), planned[-1])[1])
        got = ann.search(df, F.col("vec_id") % 100 == 0, scan_share=0.2).toPandas()
    assert (planned[0] is not None) == near
    x = x.astype(np.float64)
    found = 0
    for q, rows in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        assert np.allclose(rows["score"], score[rows["vec_id"]], atol=1e-12)
        if 5000 <= q < 7000:
            same = [i for i in range(5000, 7000) if i != q][:20]
            assert sorted(rows["vec_id"]) == same
        found += len(set(np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:20]) & set(rows["vec_id"]))
    assert got["query_id"].nunique() == 100 and found / 2000 >= 0.9


def brute_links(rows):
    x = {i: (np.array(v, dtype=np.float64), l) for i, v, l, *_ in rows if i is not None and good(v) and l is not None}
    links = {i: {j for j in x if j != i and x[i][1] == x[j][1] and x[i][0] @ x[j][0] / np.linalg.norm(x[i][0]) / np.linalg.norm(x[j][0]) >= 0.98} for i in x}
    return links


def component(links, i):
    seen, todo = {i}, [i]
    while todo:
        new = links.get(todo.pop(), set()) - seen
        seen |= new
        todo += new
    return min(seen)


@pytest.mark.parametrize("most", [2048, 3])
def test_vector_dedup(spark, most):
    rows = odd_vectors(np.random.default_rng(2))
    df = spark.createDataFrame(rows, VECTORS)
    links = brute_links(rows)
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.find_links(df, most=most).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i in got:
        if i is None:
            assert got[i] == (0, None, True)
        else:
            c = component(links, i)
            assert got[i] == (len(links.get(i, ())), c, i == c), i
    assert vector_dedup.find_links(df.limit(0)).count() == 0
    assert vector_dedup.find_links(df.filter("vec_id = 1000")).collect()[0]["kept"]


def test_vector_dedup_with_a_common_direction(spark):
    """Links of vectors that share a strong direction are found as well."""
    r = np.random.default_rng(7)
    x = 0.1 * r.standard_normal((2000, 24)) + np.eye(24)[0]
    x[1000:] = x[:1000] + 0.025 * r.standard_normal((1000, 24))
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0, "k", 0) for i, v in enumerate(x)]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.find_links(spark.createDataFrame(rows, VECTORS)).collect()}
    assert near.sum() >= 1000
    assert [got[i] for i in range(2000)] == near.sum(axis=1).tolist()


def test_bpe(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    tok = bpe_tree.load(path)
    texts = [*odd_texts(), (50, "a<|endoftext|>b <|startoftext|>"), (51, "É\u0301t\u00e9 ÀÉ ﬁ　漢字 don't it's!!'s"), (52, "ab" * 40000), (53, "the 's ! é" * 9000), (54, "a\u2028b\x85c\x1cd\u00a0e")]
    got = sorted((tuple(r) for r in bpe_tree.encode_documents(documents(spark, texts), path, split=5000).collect()), key=repr)
    want = []
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe_tree.encode_documents(documents(spark, []), path).count() == 0


def test_long_unsplit_texts_are_encoded_in_pieces(spark):
    """Texts without blanks, or with few, over many pieces and more than one level of joins."""
    path = queries.vocabulary("word_bpe_49k.json")
    tok = bpe_tree.load(path)
    r = random.Random(8)
    part = lambda n: "".join(r.choice(["thequick", "ab", "!'s", "12", "é", "tion", "don't", "ß", "漢", "x" * 9]) for _ in range(n))
    texts = [(1, part(200_000)), (2, part(9000) + " " + part(3000) + "\n" + part(20_000)), (3, " ".join(part(900) for _ in range(40))), (4, part(30_000) + " "), (5, " " + "a" * 100_000)]
    got = {x["doc_id"]: x["ids_sha256"] for x in bpe_tree.encode_documents(documents(spark, texts), path, split=8192, fan=8).collect()}
    for i, t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), i


def test_a_join_encodes_a_window_only(monkeypatch):
    """What is encoded anew at a join does not grow with the sides."""
    words = bpe_tree.Words(bpe_tree.load(queries.vocabulary("word_bpe_49k.json")))
    r = random.Random(9)
    a, b = ("".join(r.choice(["thequick", "ab", "12", "é", "tion"]) for _ in range(20_000)) for _ in range(2))
    left, right = bpe_tree.piece(words, a), bpe_tree.piece(words, b)
    sizes = []
    plain = bpe_tree._plain
    monkeypatch.setattr(bpe_tree, "_plain", lambda tok, t: (sizes.append(len(t)), plain(tok, t))[1])
    one = bpe_tree.join(words, left, right)
    assert sum(sizes) < 1000
    assert one[0].encoded[0] == words.tok.encode(a + b, add_special_tokens=False).ids


def test_tree_of_one_long_word():
    tok = bpe_tree.load(queries.vocabulary("word_bpe_49k.json"))
    r = random.Random(5)
    for k in range(60):
        t = "".join(r.choice(["thequick", "ab", "!'s", "12", "é", "tion", "don't", "ß", "漢", "x" * 9]) for _ in range(r.choice([100, 400])))
        assert bpe_tree.tree_ids(tok, t, leaf=r.choice([40, 90]))[0] == tok.encode(t, add_special_tokens=False).ids


def brute_chats(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    whole = {c: tuple((x[1], x[2]) for x in sorted(v)) for c, v in convs.items()}
    prefixes = {w[:k] for w in whole.values() for k in range(1, len(w))}
    out = []
    for w in set(whole.values()):
        if w not in prefixes:
            same = [c for c in whole if whole[c] == w]
            first = min((c for c in same if c is not None), default=None)
            out.append((first, len(w), len(same), "".join(f"<|im_start|>{r[1]}\n{t[1]}<|im_end|>\n" for r, t in w)))
    return sorted(out, key=repr)


def test_chat(spark):
    r = random.Random(3)
    rows = []
    for c in range(60):
        n = r.randint(1, 5)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"say {c % 6} {t}" if r.random() < 0.95 else f"other {c}") for t in range(n)]
    rows += [(100, None, "user", "x"), (101, 0, None, None), (102, 0, None, ""), (103, 0, "", ""), (104, 0, "user", "y"), (104, 0, "user", "y"), (105, 0, "user", "y"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*x, "pos", 1) for x in rows], "conv_id long, turn long, role string, text string, pos string, n_turns int")
    assert sorted((tuple(x) for x in chat.format_chats(df).collect()), key=repr) == brute_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def near_copies(seed=4):
    r = random.Random(seed)
    texts = odd_texts()
    for k in range(25):
        base = prose(1000 + k, r.choice([30, 90, 300]), 400).split()
        for j in range(r.choice([2, 3, 8])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                own[r.randrange(len(own))] = f"new{r.random()}"
            texts.append((10_000 + 100 * k + j, " ".join(own)))
    return texts


def brute_jaccard(texts):
    def grams(t):
        w = (t or "").lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    sets = [grams(t) for _, t in texts]
    return {a: {b for b in range(len(sets)) if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in range(len(sets))}


@pytest.mark.parametrize("small", [128, 4])
def test_jaccard(spark, small, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 512 if small > 4 else 3)
    original = jaccard.candidate_edges
    monkeypatch.setattr(jaccard, "candidate_edges", lambda *a, **k: original(*a, small=small, **k))
    texts = near_copies()
    links = brute_jaccard(texts)
    want = []
    for a, (i, _) in enumerate(texts):
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        want.append((i, min((texts[b][0] for b in seen if texts[b][0] is not None), default=None), len(links[a])))
    got = [tuple(r) for r in jaccard.join(documents(spark, texts)).select("doc_id", "class_id", "n_links").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_common_passage_makes_no_large_family(spark):
    """Texts that are unlike but for one passage that all have: candidates stay few."""
    words = lexicon(21, 4000)
    r = random.Random(22)
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = [(i, " ".join(r.choice(words) for _ in range(60)) + " " + passage) for i in range(3000)]
    found = jaccard.sets(documents(spark, texts).select("doc_id", "text", F.col("doc_id").alias("row")), jaccard.runs_for()).withColumnRenamed("row", "rep")
    scratch = common.Scratch(spark, "families")
    family = components(jaccard.candidate_edges(scratch.table(found, "reps"), scratch, small=512), scratch)
    largest = family.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    assert largest <= 30
    scratch.close()


def test_jaccard_misses_are_within_the_budget():
    """Pairs at the threshold share a path at least as often as stated; their sketches agree."""
    r = np.random.default_rng(23)
    paths = close = 0
    n = 3000
    for _ in range(n):
        both = r.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = np.unique(both), np.unique(both[:160])
        nodes = np.intersect1d(jaccard.chosen(a, 1), jaccard.chosen(b, 1))
        for _ in range(jaccard.DEPTH - 1):
            nodes = np.concatenate([np.zeros(0, dtype=np.uint64), *[np.intersect1d(*[jaccard.children(np.array([v]), [jaccard.sampled(x)])[1] for x in (a, b)]) for v in nodes]])
        paths += len(nodes) > 0
        close += (jaccard.sketch(a) == jaccard.sketch(b)).sum() >= jaccard.SKETCH_LEAST
    assert paths / n >= jaccard.survival() - 0.03
    assert close >= n - 1
    assert jaccard.sketch_miss() < 1e-5
    assert (1 - jaccard.survival()) ** jaccard.runs_for() + jaccard.sketch_miss() <= jaccard.MISS


def test_jaccard_keeps_one_of_each_class(spark):
    texts = near_copies()
    docs = documents(spark, texts)
    kept = [r["doc_id"] for r in jaccard.keep_first(docs).collect()]
    classes = {(r["doc_id"], r["row"]): r["first"] for r in jaccard.join(docs).collect()}
    assert len(kept) == len(set(classes.values()))
    assert jaccard.keep_first(docs).columns == docs.columns
    assert jaccard.keep_first(documents(spark, [])).count() == 0
    assert jaccard.join(documents(spark, [])).count() == 0


def brute_substring(texts, least=substring.MIN_WORDS, least_run=substring.MIN_RUN):
    key = lambda i, t: (i is not None, i or 0)
    first = {}
    for i, t in sorted(texts, key=lambda x: key(*x)):
        for k, (a, b, w) in enumerate(substring.units(t or "")):
            assert w == t[a:b].lower().split()
            if len(w) >= least:
                first.setdefault(tuple(w), (i, t, k))
    out = []
    for i, t in texts:
        if not t:
            out.append((i, t))
            continue
        spans = substring.units(t)
        assert [a for a, *_ in spans] == [0, *[b for _, b, _ in spans[:-1]]] and spans[-1][1] == len(t)
        ws = [w for *_, w in spans]
        gone = [len(w) >= least and first[tuple(w)] != (i, t, k) for k, w in enumerate(ws)]
        gone = [g or (len(ws[k]) < least and 0 < k < len(ws) - 1 and gone[k - 1] and gone[k + 1]) for k, g in enumerate(gone)]
        keep = []
        for g, run in itertools.groupby(range(len(ws)), gone.__getitem__):
            run = list(run)
            keep += [not g or sum(len(ws[k]) for k in run) < least_run] * len(run)
        out.append((i, "".join(t[a:b] for (a, b, _), x in zip(spans, keep, strict=True) if x)))
    return out


def test_substring(spark):
    passage = "This passage has quite a few words in it. Short one. And it goes on for several more words here! Then it ends after these final words."
    texts = [(i, t) for i, t in odd_texts() if i is None or i < BIG]
    texts += [(200 + i, prose(300 + i, 20) + " " + passage + " " + prose(400 + i, 15) + "\nline of its own that repeats everywhere\n") for i in range(6)]
    texts += [(BIG, texts[-1][1]), (BIG, texts[-1][1])]
    out = substring.dedup(documents(spark, texts))
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute_substring(texts), key=repr)
    for i, t, spans in [(r["doc_id"], r["text"], r["removed"]) for r in out.filter("doc_id between 200 and 300").collect()]:
        old = dict(texts)[i]
        at = [0, *[x for s in spans for x in (s["start"], s["end"])], len(old)]
        assert "".join(old[a:b] for a, b in zip(at[::2], at[1::2], strict=True)) == t
    every = [(r["doc_id"], r["text"]) for r in substring.dedup(documents(spark, texts), least_run=1).collect()]
    assert sorted(every, key=repr) == sorted(brute_substring(texts, least_run=1), key=repr)
    assert sum("goes on for several more words" in (t or "") for _, t in every) == 1
    assert substring.dedup(documents(spark, [])).count() == 0
    assert substring.dedup(documents(spark, texts), removed=None).columns == documents(spark, []).columns


def test_passage_without_sentence_ends():
    """Units fall on the same words of a passage wherever it stands."""
    passage = prose(77, 80).replace(".", "")
    one = {tuple(w) for *_, w in substring.units(prose(78, 33).replace(".", "") + " " + passage + " " + prose(79, 40))}
    two = {tuple(w) for *_, w in substring.units(prose(80, 12).replace(".", "") + " " + passage)}
    assert sum(map(len, one & two)) > 30


def lexicon(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


def test_passages_of_all_layouts_leave_no_shared_window(spark):
    """No 50 words in a row are left in two documents: short lines, lists, verse, code, glued sentences, words in a run."""
    words = lexicon(1, 3000)
    r = random.Random(2)
    w = lambda n: [r.choice(words) for _ in range(n)]
    line = lambda n, k, mark="": "\n" + "".join(mark + " ".join(w(k)) + "\n" for _ in range(n))
    passages = [line(20, 4), line(30, 3, "- "), line(60, 1), line(25, 3, "    "), " ".join(w(55)), " ".join(" ".join(w(r.randint(3, 30))) + "." for _ in range(8)), "again " * 90]
    texts = []
    for i, p in enumerate(passages):
        for j in range(3):
            texts.append((10 * i + j, " ".join(w(r.randint(3, 40))) + " " + p + " " + " ".join(w(r.randint(3, 40)))))
    windows = lambda t: {tuple(x[i : i + 50]) for x in [t.lower().split()] for i in range(len(x) - 49)}
    shared = lambda rows: sum(n > 1 for n in Counter(x for _, t in rows for x in windows(t)).values())
    assert shared(texts) > 0
    got = {x["doc_id"]: x["text"] for x in substring.dedup(documents(spark, texts)).collect()}
    assert shared(got.items()) == 0
    assert all(len(got[i].split()) == len(t.split()) for i, t in texts if i % 10 == 0 and i < 60)


def test_short_sentences_that_recur_stay(spark):
    """Texts that share only sentences of a few words are left alone; passages of over 50 words between them are found."""
    words = lexicon(9, 3000)
    r = random.Random(10)
    short = [" ".join(r.choice(words) for _ in range(r.randint(5, 9))) + "." for _ in range(40)]
    passages = [" ".join(" ".join(r.choice(words) for _ in range(r.randint(6, 20))) + "." for _ in range(6)) for _ in range(20)]
    own = lambda: " ".join(r.choice(words) for _ in range(r.randint(8, 30))) + "."
    texts = [(i, " ".join(x for _ in range(8) for x in (own(), r.choice(short)))) for i in range(300)]
    planted = [(1000 + 10 * i + j, f"{own()} {p} {own()}") for i, p in enumerate(passages) for j in range(2)]
    got = {x["doc_id"]: x["text"] for x in substring.dedup(documents(spark, texts + planted)).collect()}
    assert sum(got[i] == t for i, t in texts) >= 0.95 * len(texts)
    assert all(got[i] == t for i, t in planted if i % 10 == 0)
    assert all(len(t.split()) - len(got[i].split()) >= 0.5 * len(passages[(i - 1000) // 10].split()) for i, t in planted if i % 10)


def test_passages_without_blanks(spark):
    """Chinese passages: most letters of a repeat go, the first copy stays."""
    r = random.Random(3)
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x6FFF)) for _ in range(n))
    passages = [han(200), "。".join(han(25) for _ in range(8))]
    texts = [(10 * i + j, han(r.randint(5, 60)) + p + han(30)) for i, p in enumerate(passages) for j in range(2)]
    got = {x["doc_id"]: x["text"] for x in substring.dedup(documents(spark, texts)).collect()}
    for i, t in texts:
        assert len(got[i]) == len(t) if i % 10 == 0 else len(t) - len(got[i]) > 120


def test_packing(spark):
    paths = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken"), queries.byte_pattern()
    texts = [*odd_texts(), (60, "a<|endoftext|>b"), (61, "漢字 \x85 é"), *[(100 + i, prose(i, i * 7)) for i in range(80)]]
    slow = packing.Ids(paths[0], None, None)
    rows = packing.pack(documents(spark, texts), *paths).collect()
    want = defaultdict(int)
    for i, t in texts:
        ids = np.array([*slow(t or ""), 0], dtype="<u4")
        want[(i, len(ids))] += len(ids)
    got = defaultdict(int)
    for r in rows:
        got[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert got == want
    by_text = {i: np.array([*slow(t or ""), 0], dtype="<u4") for i, t in texts if [j for j, _ in texts].count(i) == 1}
    for r in rows:
        if r["doc_id"] in by_text:
            assert r["ids_crc32"] == zlib.crc32(by_text[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    packs = defaultdict(list)
    for r in rows:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in packs.values():
        p.sort()
        assert [o for o, _ in p] == list(np.cumsum([0, *[n for _, n in p]])[:-1]) and sum(n for _, n in p) <= 1024
    total = sum(r["length"] for r in rows)
    assert len(packs) <= 1.1 * total / 1024 + 1
    assert packing.pack(documents(spark, []), *paths).count() == 0


def test_shortest_pack_first_places_everything():
    r = random.Random(6)
    h = {n: r.randint(0, 50) for n in range(1, 1025)}
    patterns = packing.shortest_pack_first(h)
    placed = Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 1024
        for n in lengths:
            placed[n] += count
    assert placed == Counter({k: v for k, v in h.items() if v})


def test_quality(spark, sf):
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    out = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((out["score"] >= 0.5) == (out["quality"] == 1)).mean() > 0.95
    assert (out["predicted"][out["quality"] == 1] == 1).mean() > 0.98
    assert out["score"].between(0, 1).all()


def brute_vote(model, counts):
    """Score of one text: every labelled vector in turn, the nearest first, then the first in order."""
    total = max(1.0, float(sum(counts[:-1])))
    x = np.array([np.log1p(c * 2000.0 / total) * w for c, w in zip(counts.astype(float), model.idf.astype(float), strict=True)])
    at = np.array([sum(x * axis) for axis in model.basis.T.astype(float)])
    near = [float(at @ p) / np.linalg.norm(at) for p in model.points.astype(float)]
    top = sorted(range(len(near)), key=lambda i: (-near[i], i))[: model.k]
    w = [max(near[i], 1e-6) ** 4 for i in top]
    return sum(a * model.labels[i] for a, i in zip(w, top, strict=True)) / sum(w)


def test_quality_by_brute_force(spark):
    """Votes over all labelled vectors by plain loops; a labelled text of a megabyte is whole."""
    texts = [(i, prose(i % 40, 30 + 7 * (i % 5), 60)) for i in range(200)] + [(300, "abc " * 262_144), (301, None), (302, "")]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 40 < 20), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, t in texts[::3] + texts[-3:]:
        assert abs(got[i] - brute_vote(model, quality.features(t))) < 1e-3, i
    big = quality.features("abc " * 262_144)
    assert big.max() > 500_000 and np.isfinite(big).all()


def test_quality_ties_go_to_the_first():
    x = np.array([[1.0, 2.0, 2.0, 0.0, 2.0, 1.0], [1.0] * 6, [5.0, 4.0, 3.0, 2.0, 1.0, 0.0]])
    assert quality.first_largest(x, 2).tolist() == [[1, 2], [0, 1], [0, 1]]
    assert quality.first_largest(x, 4).tolist() == [[0, 1, 2, 4], [0, 1, 2, 3], [0, 1, 2, 3]]


def test_quality_edges(spark):
    docs = documents(spark, odd_texts())
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in range(20, 36)] + [(20, 0, 1, "x"), (None, 1, 0, "x"), (3, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    out = quality.classify(docs, labels)
    assert out.count() == len(odd_texts()) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def sql_rows(folder, sql):
    con = duckdb.connect()
    for name in ("pages", "labels", "conversations"):
        if glob.glob(f"{folder}/{name}.parquet"):
            con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{name}.parquet') else ''}')")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    columns, rows = sql_rows(sf, queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


@pytest.mark.parametrize("first", ["allow", "block"])
def test_of_rules_of_one_length_allow_wins(spark, first):
    both = sorted([("allow", "a.io", "/x"), ("block", "io", "/x/y"), ("block", "b.io", "/x"), ("allow", "io", "/x/z")], key=lambda r: r[0] != first)
    urls = spark.createDataFrame([(0, "http://a.io/x/y"), (1, "http://b.io/x/z"), (2, "http://b.io/x/y"), (3, "http://a.io/xy")], "page_id long, url string")
    out = url_filter.filter_urls(urls, spark.createDataFrame([], "doc_id long, quality int, toxic int"), rules=both)
    # a.io/x and io/x/y have six characters each; so have b.io/x and io/x/z.
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()} == {0: ("a.io/x", "allow"), 1: ("io/x/z", "allow"), 2: (out_rule(both), "block"), 3: ("a.io/x", "allow")}


def out_rule(rules):
    """Of two rules with one verdict and length, the one given last."""
    return [h + p for v, h, p in rules if v == "block"][-1]


def test_url_filter(spark, tmp_path):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7x?y#z", "http://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/8/1", "https://b.org/es/x", "http://É.org#f://q", "http://a\nb.com/en/\n?x", "x://y://z/en/", "http://bad.example.io/1", "http://example.com?a=/en/"]
    pages = [(i, u, "<p>", "h") for i, u in enumerate(urls)] + [(1000 + i, "http://bad.host.io/" + str(i), None, "h") for i in range(60)] + [(2000 + i, "http://good.host.io/" + str(i), None, "h") for i in range(60)] + [(None, "http://a.com/", None, "h"), (1000, "http://bad.host.io/0", None, "h")]
    labels = [(1000 + i, 0, 0) for i in range(40)] + [(2000 + i, 1, 0) for i in range(40)] + [(2000, None, 0), (None, 1, 1), (1001, 1, None)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    out = url_filter.filter_urls(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = out.collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    for i, u, *_ in pages:
        host, path, rule = brute_url(u)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule and rule[0]), u
        if rule:
            assert by[i]["verdict"] == rule[1]
    assert by[1000]["verdict"] == "block" and by[2000]["verdict"] == "allow"
    assert by[1000]["good_rate"] < by[13]["good_rate"] < by[2000]["good_rate"]
    p.write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns, rows = sql_rows(str(tmp_path), url_filter.oracle_sql())
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in columns)) for r in got)
    assert url_filter.filter_urls(p.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    assert url_filter.filter_urls(p, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("rule is null and verdict = 'block'").count() == 0


def test_native_plans_have_no_python(spark, sf):
    for name in ("op4_chat", "op10_url_filter"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_shared_folder_is_asked_for_on_a_cluster():
    class Spark:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: {}})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Spark())


def test_release_frees_tables(spark):
    import os

    scratch = common.Scratch(spark, "freed")
    t = scratch.table(spark.range(3), "t")
    path = t._docwright_path.removeprefix("file://")
    assert os.path.isdir(path)
    common.release()
    assert not os.path.exists(path)
