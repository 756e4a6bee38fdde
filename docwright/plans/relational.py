"""Relational core over orders, customers, line items and nations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docwright.operators import relational as R

from .registry import query, table

MONEY = "decimal(18,2)"


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def count_by_type(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderstatus")


@query("SELECT count(*) AS total, count(quality) AS labelled, round(count(quality)::DOUBLE / nullif(count(*), 0), 6) AS ratio FROM documents LEFT JOIN labels USING (doc_id)")
def non_null_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("labelled"), F.round(F.try_divide(F.count("quality").cast("double"), F.count(F.lit(1))), 6).alias("ratio"))


@query("""SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS successful, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed,
count(*) FILTER (WHERE o_orderstatus = 'O') AS skipped, count(*) AS total, round(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*), 6) AS success_ratio
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")  # fmt: skip
def run_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return o.groupBy("c_mktsegment").agg(n("F").alias("successful"), n("P").alias("failed"), n("O").alias("skipped"), F.count(F.lit(1)).alias("total"), F.round(n("F") / F.count(F.lit(1)), 6).alias("success_ratio"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_topn(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


@query("""SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')
ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey LIMIT 25""")
def case_rank_topn(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O", "P"))
    return o.orderBy(rank, F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def per_key_cap(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM orders WHERE o_orderstatus IN ('F', 'O')) WHERE rn = 1""")
def latest_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    last = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey"))
    return o.groupBy("o_custkey").agg(last.alias("r")).select("o_custkey", "r.*")


@query("""SELECT o_custkey, count(*) AS n_periods, max(o_orderdate) AS latest, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey) AS order_keys
FROM orders GROUP BY 1""")
def list_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("d"), "o_orderkey").alias("s"))
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["o_orderkey"].cast("string")), ",")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_periods"), F.max("o_orderdate").alias("latest"), keys.alias("order_keys"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def processed_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01')
ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def anti_join_unprocessed(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return R.unprocessed(table(spark, sf_dir, "customer"), done, "c_custkey", [F.desc("c_acctbal"), F.col("c_custkey")], 50).select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT c_custkey, lpad(c_nationkey::VARCHAR, 10, '0') AS nation_code, coalesce(n_name, upper(left(c_name, 5))) AS nation
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey""")
def dim_lookup_coalesce(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(R.zero_fill(F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("nation"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", R.zero_fill(F.col("c_nationkey").cast("string")).alias("nation_code"))
    return R.lookup(c, dim, F.col("nation_code") == F.col("code"), {"nation": F.upper(F.left("c_name", F.lit(5)))}).select("c_custkey", "nation_code", "nation")


BATCH = "SELECT c_custkey, 'batch ' || c_custkey AS c_name, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey + 1000000, 'new ' || c_custkey, c_acctbal, 'NEW' FROM customer WHERE c_custkey % 50 = 0"


def _batch(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.filter("c_custkey % 7 = 0").selectExpr("c_custkey", "concat('batch ', c_custkey) AS c_name", "c_acctbal + 1 AS c_acctbal", "'NEW' AS c_mktsegment")
    return a.union(c.filter("c_custkey % 50 = 0").selectExpr("c_custkey + 1000000", "concat('new ', c_custkey)", "c_acctbal", "'NEW'"))


@query(f"""WITH b AS ({BATCH}), t AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer)
SELECT coalesce(t.c_custkey, b.c_custkey) AS c_custkey, coalesce(t.c_name, b.c_name) AS c_name, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
coalesce(t.c_mktsegment, b.c_mktsegment) AS c_mktsegment FROM t FULL JOIN b ON t.c_custkey = b.c_custkey""")
def upsert_subset(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return R.upsert(t, _batch(spark, sf_dir), ["c_custkey"], ["c_acctbal"], [F.desc("c_acctbal")])


@query(f"""WITH b AS ({BATCH}) SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def insert_if_absent(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return R.insert_if_absent(t, _batch(spark, sf_dir), ["c_custkey"], [F.desc("c_acctbal")])


PATHS = "SELECT concat_ws('/', 'bronze', 'sec-edgar', ltrim(o_custkey::VARCHAR, '0'), o_orderstatus, o_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'document.html' ELSE 'metadata.json' END) AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"""SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM ({PATHS}) GROUP BY 1
HAVING bool_or(path LIKE '%/document.html') AND bool_or(path LIKE '%/metadata.json')""")
def completeness_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = lambda name: R.object_key(F.lit("bronze"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"), name)
    paths = o.select(F.when(F.col("l_linenumber") % 2 == 1, key("document.html")).otherwise(key("metadata.json")).alias("path"))
    return R.complete_directories(paths)


@query("""SELECT s || ': ' || n_name || ' Q' || q || ' ' || y AS question FROM (VALUES ('revenue'), ('margin')) a(s), nation, (VALUES (1), (2), (3), (4)) b(q), (VALUES (2022), (2023)) c(y)
ORDER BY s, n_nationkey, y, q LIMIT 100""")
def cross_product_cap(spark, sf_dir):
    fill = lambda name, values: spark.createDataFrame([(v,) for v in values], name)
    n = table(spark, sf_dir, "nation").crossJoin(fill("s string", ["revenue", "margin"])).crossJoin(fill("q int", [1, 2, 3, 4])).crossJoin(fill("y int", [2022, 2023]))
    return n.orderBy("s", "n_nationkey", "y", "q").limit(100).select(F.format_string("%s: %s Q%d %d", "s", "n_name", "q", "y").alias("question"))


@query("""SELECT o_orderstatus, o_orderkey, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def first_three_per_type(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "orders"), ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, "rank").select("o_orderstatus", "o_orderkey", "rank")


@query("""SELECT o_custkey, count(*) AS batches, sum(n)::BIGINT AS lines, bool_and(n = q) AS consistent FROM (
SELECT o_custkey, o_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1""")
def batch_verification(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = o.groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_linenumber").alias("q"))
    return per.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("lines"), F.bool_and(F.col("n") == F.col("q")).alias("consistent"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAYS")
def recency_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    last = o.agg(F.max("o_orderdate").alias("last"))  # one row
    return o.crossJoin(F.broadcast(last)).filter(F.col("o_orderdate") > F.col("last") - F.expr("INTERVAL 7 DAYS")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus IN ('F', 'O') AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1995-03-31'")
def membership_date_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.filter(F.col("o_orderstatus").isin("F", "O") & F.col("day").between("1995-01-01", "1995-03-31")).select("o_orderkey", "o_orderstatus", "day")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS present FROM customer")
def existence_probe(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("present", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("present", F.lit(False)).alias("present"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'Unknown') AS k, coalesce(json_extract_string(props, '$.source'), 'Unknown') AS source FROM events")
def json_field_default(spark, sf_dir):
    f = lambda p: F.coalesce(F.get_json_object("props", p), F.lit("Unknown"))
    return table(spark, sf_dir, "events").select("event_id", f("$.k").alias("k"), f("$.source").alias("source"))


@query("SELECT doc_id, left(text, 100) AS preview, contains(lower(text), 'license') AS licensed FROM documents")
def preview_and_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(100)).alias("preview"), F.contains(F.lower("text"), F.lit("license")).alias("licensed"))


@query("""SELECT event_type, n, n_valid, n_issue, issues FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 1) AS n_valid, count(*) FILTER (WHERE value < 1) AS n_issue,
coalesce(string_agg(CASE WHEN value < 1 THEN event_id::VARCHAR END, ',' ORDER BY event_id), '') AS issues FROM events GROUP BY 1)""")
def cache_validation(spark, sf_dir):
    bad = F.col("value") < 1
    e = table(spark, sf_dir, "events")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad, F.col("event_id")))), lambda x: x.cast("string")), ",")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 1).alias("n_valid"), F.count_if(bad).alias("n_issue"), ids.alias("issues"))


@query("""SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER w AS prev_line, lead(l_linenumber) OVER w AS next_line FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def prev_next_chunk(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber").over(w).alias("prev_line"), F.lead("l_linenumber").over(w).alias("next_line"))
