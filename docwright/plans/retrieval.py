"""Retrieval and evaluation over embeddings: queries are the vectors whose id is divisible by 100, against all; relevant are vectors of the same label."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.functions import vectors
from docwright.operators import retrieval as R

from .registry import query, table

KNN = """
sims AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, q.label AS ql, c.label AS cl,
         round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 10)"""

SCORED = (
    KNN
    + """,
n_exp AS (SELECT q.vec_id AS query_id, count(c.vec_id) AS n_expected FROM embeddings q LEFT JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1),
per AS (SELECT query_id, sum(CASE WHEN ql = cl THEN {gain} ELSE 0.0 END) AS dcg, count(*) AS n_ret,
               count(DISTINCT CASE WHEN ql = cl AND rank <= 5 THEN vec_id END) AS found, min(CASE WHEN ql = cl THEN rank END) AS first_hit
        FROM hits GROUP BY 1),
scored AS (SELECT query_id, coalesce(dcg / nullif(list_sum([{ideal} FOR i IN range(1, least(n_expected, {cap})::BIGINT + 1)]), 0), 0.0) AS ndcg,
                  coalesce(found::DOUBLE / nullif(n_expected, 0), 0.0) AS recall, coalesce(1.0::DOUBLE / first_hit, 0.0) AS mrr
           FROM per JOIN n_exp USING (query_id))"""
)


def scored_sql(gain="1.0::DOUBLE / rank", ideal="1.0::DOUBLE / i", cap="n_ret") -> str:
    return "WITH " + SCORED.format(gain=gain, ideal=ideal, cap=cap)


ROUNDED = " SELECT query_id, round(ndcg, 9) AS ndcg, round(recall, 9) AS recall, round(mrr, 9) AS mrr FROM scored"


def asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def hits(spark, sf_dir, k=10):
    return R.vector_topk(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), k)


def scores(spark, sf_dir, **kw):
    """A label's number of vectors, less the query's own, is what a query expects."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asking = asked(spark, sf_dir).select("query_id", F.col("label").alias("ql"))
    sizes = e.groupBy(F.col("label").alias("ql")).agg(F.count(F.lit(1)).alias("n"))
    wanted = asking.join(sizes, "ql", "left").select("query_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_expected"))
    flagged = hits(spark, sf_dir).join(asking, "query_id").join(e, "vec_id").withColumn("hit", F.when(F.col("ql") == F.col("label"), 1))
    return R.flagged_scores(flagged, wanted, **kw)


def rounded(df):
    return df.select("query_id", *[F.round(c, 9).alias(c) for c in ("ndcg", "recall", "mrr")])


@query("WITH " + KNN + " SELECT query_id, vec_id, score, rank::INT AS rank FROM hits")
def knn_topk(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "vec_id", "score", "rank")


@query("WITH " + KNN + " SELECT query_id, vec_id, score, rank::INT AS rank FROM hits")
def knn_topk_expressions(spark, sf_dir):
    return R.vector_topk(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, exact=False).select("query_id", "vec_id", "score", "rank")


@query("WITH " + KNN + " SELECT query_id, vec_id, score, rank::INT AS rerank FROM hits WHERE rank <= 5")
def rerank_topn(spark, sf_dir):
    return R.rerank(hits(spark, sf_dir)).select("query_id", "vec_id", "score", "rerank")


@query(
    "WITH "
    + KNN
    + """ SELECT query_id, rank::INT AS rank, substr(d.text, 1, 100) || '...' AS span, score AS confidence, substr(sha256(d.text), 1, 16) AS sha256
FROM hits JOIN documents d ON d.doc_id = hits.vec_id WHERE rank <= 3"""
)
def citations_top3(spark, sf_dir):
    top = R.rerank(hits(spark, sf_dir), 3)
    cited = top.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return cited.select("query_id", F.col("rerank").alias("rank"), R.citation(F.col("text"), F.col("score")).alias("c")).select("query_id", "rank", "c.*")


@query(scored_sql() + ROUNDED)
def eval_retrieval(spark, sf_dir):
    return rounded(scores(spark, sf_dir))


@query(scored_sql(cap="10") + ROUNDED)
def eval_retrieval_nightly(spark, sf_dir):
    return rounded(scores(spark, sf_dir, cap="k"))


@query(scored_sql(gain="1.0::DOUBLE / log2(rank + 1)", ideal="1.0::DOUBLE / log2(i + 1)") + ROUNDED)
def eval_retrieval_log2(spark, sf_dir):
    return rounded(scores(spark, sf_dir, discount="log2"))


MEANS = " SELECT round(avg(ndcg), 9) AS mean_ndcg, round(avg(recall), 9) AS mean_recall, round(avg(mrr), 9) AS mean_mrr, count(*) AS n_queries, 0::BIGINT AS n_errors FROM scored"


@query(scored_sql() + MEANS)
def eval_summary(spark, sf_dir):
    m = R.mean_scores(scores(spark, sf_dir))
    return m.select(*[F.round(c, 9).alias(c) for c in ("mean_ndcg", "mean_recall", "mean_mrr")], "n_queries", "n_errors")


@query(
    scored_sql()
    + """, m AS (SELECT avg(ndcg) AS a, avg(recall) AS b, avg(mrr) AS c FROM scored)
SELECT * FROM (SELECT 'ndcg' AS metric, round(a, 9) AS value, 0.75::DOUBLE AS threshold FROM m UNION ALL SELECT 'recall', round(b, 9), 0.85 FROM m UNION ALL SELECT 'mrr', round(c, 9), 0.6 FROM m) WHERE value < threshold"""
)
def eval_alerts(spark, sf_dir):
    return R.alerts(R.mean_scores(scores(spark, sf_dir))).withColumn("value", F.round("value", 9))


@query("SELECT vec_id, 1536::INT AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def vector_pad(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.pad(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(
    """SELECT state, count(*) AS n FROM (SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) = 0 THEN 'empty'
WHEN len(list_filter(embedding[1:10], lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'valid' END AS state FROM embeddings) GROUP BY 1"""
)
def vector_validity(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(vectors.validity(F.col("embedding")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH "
    + KNN
    + """, a AS (SELECT query_id, list(vec_id ORDER BY rank) AS ids FROM hits WHERE rank <= 5 GROUP BY 1),
b AS (SELECT query_id, list(vec_id ORDER BY rank) AS ids FROM hits WHERE rank <= 4 GROUP BY 1)
SELECT a.query_id, CASE WHEN len(list_filter(a.ids, lambda x: NOT list_contains(b.ids, x))) = 0 AND len(list_filter(b.ids, lambda x: NOT list_contains(a.ids, x))) = 0 THEN 'equal'
WHEN len(list_filter(b.ids, lambda x: NOT list_contains(a.ids, x))) = 0 THEN 'superset' ELSE 'differs' END AS relation FROM a JOIN b USING (query_id)"""
)
def citation_overlap(spark, sf_dir):
    top = hits(spark, sf_dir)
    ids = lambda n, name: top.filter(F.col("rank") <= n).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias(name))
    return ids(5, "a").join(ids(4, "b"), "query_id").select("query_id", R.id_overlap(F.col("a"), F.col("b")).alias("relation"))
