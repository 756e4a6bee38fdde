"""Queries for the smaller record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.functions import vectors
from docwright.operators import metrics as M
from docwright.operators import records as C
from docwright.operators import retrieval as R

from .registry import query, table
from .structure import FOUND, found_entities


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def recent_filtered(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return C.select_recent(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 30, o_orderstatus="F", o_orderpriority=None).select("o_orderkey", "o_totalprice")


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages WHERE contains(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 'the')")
def title_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return C.title_contains(p, "title", "THE")


@query(f"WITH {FOUND} SELECT doc_id, label, text FROM e WHERE label = 'PERCENT'")
def entity_filter(spark, sf_dir):
    return C.entities_of(found_entities(spark, sf_dir), ["PERCENT"], 0.9).select("doc_id", "label", "text")


@query("SELECT count(*) AS n, 0::BIGINT AS n_invalid, 0.0::DOUBLE AS ratio, true AS valid FROM embeddings")
def embedding_gate(spark, sf_dir):
    return C.require_valid(table(spark, sf_dir, "embeddings"), vectors.validity(F.col("embedding")))


@query("SELECT 'tc_nation' AS name, true AS present, count(*) AS rows FROM nation UNION ALL SELECT 'tc_absent', false, NULL")
def table_probe(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("tc_nation")
    return C.table_counts(spark, ["tc_nation", "tc_absent"])


@query("SELECT page_id, url, length(html)::INT AS n, quality FROM pages JOIN labels ON doc_id = page_id")
def two_source_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("n"))
    return p.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), "quality"), "page_id")


@query("""SELECT a.o_custkey, a.o_orderkey AS i_start, a.o_orderkey + 10 AS i_end, b.o_orderkey - 500 AS o_start, b.o_orderkey + 500 AS o_end
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey >= b.o_orderkey - 500 AND a.o_orderkey + 10 <= b.o_orderkey + 500""")
def region_containment(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    region = lambda a, b: o.select("o_custkey", (F.col("o_orderkey") + a).alias("start"), (F.col("o_orderkey") + b).alias("end"))
    return C.contained(region(0, 10), region(-500, 500), "o_custkey")


@query("SELECT event_id, coalesce(n_name, 'Unknown') AS service FROM events LEFT JOIN nation ON n_nationkey = user_id % 40")
def service_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).cast("int").alias("n_nationkey"))
    return e.join(table(spark, sf_dir, "nation"), "n_nationkey", "left").select("event_id", F.coalesce("n_name", F.lit("Unknown")).alias("service"))


@query("SELECT o_custkey, o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS vals, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1, 2")
def entity_consolidation(spark, sf_dir):
    c = C.consolidate(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority")
    return c.select("o_custkey", "o_orderstatus", F.array_join("values", ",").alias("vals"), "n")


@query("""WITH s AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN hour - lag(hour) OVER w = INTERVAL 1 HOUR THEN lag(n) OVER w END AS past FROM s WINDOW w AS (PARTITION BY event_type ORDER BY hour))
SELECT *, coalesce(n > 1.5 * past, false) AS failed FROM p""")
def latency_trend(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return C.trend(s, ["event_type"], "hour", "n", 3600)


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '\n\n'))::INT + 1 AS paragraphs, len(regexp_extract_all(lower(text), 'table'))::INT AS tables, contains(lower(text), 'revenue') AS has_revenue, 'Technology' AS sector FROM documents""")
def silver_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("form", F.lit("10-K"))
    return C.silver_projection(d, "doc_id", "text", "source", "form").drop("quality")


@query("SELECT event_type, round(sum(value::DECIMAL(18,4))::DOUBLE / count(value), 9) AS mean FROM events GROUP BY 1")
def mean_sum_count(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("s"), F.count("value").cast("double").alias("c"))
    samples = e.select("event_type", F.explode(F.array(F.struct(F.lit("x_sum").alias("metric"), F.col("s").alias("value")), F.struct(F.lit("x_count").alias("metric"), F.col("c").alias("value")))).alias("m")).select("event_type", "m.*")
    return C.mean_of_sum_count(samples, ["event_type"], "x_sum", "x_count").withColumn("mean", F.round("mean", 9))


@query("SELECT event_type, count(*) AS requests, sum(value::DECIMAL(18,4))::DOUBLE AS tokens, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def counter_family(spark, sf_dir):
    c = C.counters(table(spark, sf_dir, "events"), ["event_type"], {"tokens": F.col("value").cast("decimal(18,4)"), "errors": F.when(F.col("event_type") == "error", 1).otherwise(0)})
    return c.withColumn("tokens", F.col("tokens").cast("double"))


@query("""SELECT 'hits{route="' || event_type || '"} ' || count(*) || '.0' AS line FROM events GROUP BY event_type""")
def metrics_exposition(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return C.exposition(e.select(F.lit("hits").alias("metric"), F.create_map(F.lit("route"), "event_type").alias("labels"), "value"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return C.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "n_tokens")


@query("SELECT conv_id, turn, (contains(lower(text), 'the')::INT + contains(lower(text), 'zzz')::INT) >= 1 AS passed FROM conversations")
def answer_keywords(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.keyword_hits(F.col("text"), F.array(F.lit("The"), F.lit("zzz"))).alias("passed"))


@query("SELECT event_type, CASE WHEN event_type = 'click' THEN 0.002 ELSE 0.0015 END::DOUBLE AS estimate, CASE event_type WHEN 'click' THEN 'gpt-4o-mini' ELSE 'claude-3-haiku' END AS cheapest FROM (SELECT DISTINCT event_type FROM events)")
def cheapest_model(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    model = F.when(F.col("event_type") == "click", "gpt-4-turbo").otherwise("gpt-3")
    spent = F.when(F.col("event_type") == "click", 85.0).otherwise(95.0)
    return e.select("event_type", M.request_estimate(model, F.lit(1000)).alias("estimate"), M.budget_status(F.lit(100.0), spent, F.lit("gpt-4o"))["recommended"].alias("cheapest"))


@query("SELECT page_id, page_id % 3 <> 0 AS ok, CASE WHEN page_id % 3 <> 0 THEN 1 END::INT AS page FROM pages")
def binary_parse(spark, sf_dir):
    def parser(content: bytes) -> list[tuple[int, str]]:
        if content.startswith(b"!"):
            raise ValueError("not a document")
        return [(1, content.decode()[:10])]

    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 3 == 0, "!").otherwise(F.col("url")).cast("binary").alias("content"))
    return C.parse_binary(p, parser).select(F.col("path").cast("long").alias("page_id"), F.col("error").isNull().alias("ok"), "page")
