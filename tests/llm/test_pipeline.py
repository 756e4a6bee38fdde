"""The pipeline's stages on odd documents, and the whole against the stages' own brute force."""

import corpus_pipeline
from docwright.llm import queries

from .test_operators import brute_jaccard, brute_substring, documents, near_copies


def test_stages_on_odd_documents(spark, sf):
    docs = documents(spark, near_copies())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() >= 0
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_run_is_the_stages_in_order(spark, sf):
    docs = queries.table(spark, sf, "documents")
    good = corpus_pipeline.classify_quality(spark, docs, sf)
    texts = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert len(texts) < docs.count()
    links, kept, seen = brute_jaccard(texts), [], set()
    for a in sorted(range(len(texts)), key=lambda k: texts[k][0]):
        if a not in seen:
            kept.append(texts[a])
            todo = [a]
            seen.add(a)
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
    final = {i: t for i, t in brute_substring(sorted(kept))}
    out = corpus_pipeline.run(spark, sf)
    got = {r["doc_id"]: r["doc_tokens"] for r in out.select("doc_id", "doc_tokens").distinct().collect()}
    assert set(got) == set(final)
    from docwright.llm import packing

    ids = packing.Ids(queries.vocabulary("byte_bpe_50k.json"), None, None)
    assert all(got[i] == len(ids(t)) + 1 for i, t in final.items())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "packing"]
