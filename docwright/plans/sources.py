"""Queries over the sources' record forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.operators import relational as R
from docwright.sources import connectors as C

from .registry import query, table


@query("""SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderkey::VARCHAR AS accession_number, o_orderstatus AS form_type, strftime(o_orderdate, '%Y-%m-%d') AS filing_date FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus IN ('F', 'O') AND strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01') WHERE rn <= 2""")
def submission_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderstatus").alias("s"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    part = lambda f, name: F.transform("s", lambda x: x[f].cast("string")).alias(name)
    records = g.select(F.col("o_custkey").cast("string").alias("cik"), F.lit("x").alias("name"), F.struct(part("o_orderkey", "accessionNumber"), part("d", "filingDate"), part("o_orderstatus", "form"), part("o_orderkey", "primaryDocument")).alias("recent"))
    return C.submissions(records, ["F", "O"], "1995-01-01", None, 2).select("cik", "accession_number", "form_type", "filing_date")


@query("SELECT o_orderkey, 'https://example.org/data/' || ltrim(o_custkey::VARCHAR, '0') || '/' || replace(o_orderkey || '-24-1', '-', '') || '/doc.htm' AS url FROM orders")
def document_urls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", R.document_url("https://example.org/data", R.zero_fill(F.col("o_custkey").cast("string")), F.concat(F.col("o_orderkey").cast("string"), F.lit("-24-1")), F.lit("doc.htm")).alias("url"))


@query("""SELECT conv_id AS request_id, string_agg(role || ' ', '' ORDER BY turn, text) AS answer, count(*)::INT AS n_tokens, true AS done FROM conversations GROUP BY 1""")
def answer_stream(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    seq = F.struct("turn", "text")
    tokens = c.select(F.col("conv_id").alias("request_id"), seq.alias("seq"), F.concat(F.lit('data: {"type": "token", "content": "'), "role", F.lit(' "}')).alias("line"))
    other = c.groupBy(F.col("conv_id").alias("request_id")).agg(F.max(seq).alias("seq"))
    lines = tokens.union(other.select("request_id", "seq", F.lit('data: {"type": "done"}'))).union(other.select("request_id", "seq", F.lit(": keep-alive")))
    return C.answer_events(lines).select("request_id", "answer", "n_tokens", "done")


@query("SELECT o_custkey, count(*) AS n_periods, max(strftime(o_orderdate, '%Y-%m-%d')) AS latest FROM orders GROUP BY 1")
def export_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return C.export_summary(o, "o_custkey", "period").select("o_custkey", "n_periods", "latest")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'override' ELSE n_name END AS name FROM nation")
def dimension_override(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return C.dimension(n, n.filter("n_nationkey % 5 = 0").withColumn("name", F.lit("override")), "n_nationkey")


@query("""SELECT o_custkey::VARCHAR AS run_id, max(o_totalprice) AS ndcg FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY max(o_orderkey) DESC, o_custkey::VARCHAR LIMIT 10) GROUP BY 1""")
def tracking_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("t"), F.max("o_totalprice").alias("v"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    runs = o.select(F.struct(F.col("o_custkey").cast("string").alias("run_id"), F.col("t").alias("start_time")).alias("info"), F.struct(F.array(entry("NDCG@10", F.col("v"))).alias("metrics"), F.array(entry("k", F.lit("10"))).alias("params")).alias("data"))
    return C.tracking_runs(runs, 10).select("run_id", C.metric_by_class(F.col("metrics"), "ndcg").alias("ndcg"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), props) AS text FROM events")
def json_or_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.json_or_text(F.col("props"), "k").alias("text"))


@query("SELECT ticker, y::INT AS fiscal_year, name || ' reports on business for fiscal year ' || y || '.' AS line FROM (VALUES ('AAPL', 'Apple Inc.'), ('MSFT', 'Microsoft')) c(ticker, name), (VALUES (2022), (2023)) t(y)")
def synthetic_filings(spark, sf_dir):
    f = C.synthetic_filings(spark, [("AAPL", "Apple Inc."), ("MSFT", "Microsoft")], [2022, 2023])
    return f.select("ticker", "fiscal_year", F.get(F.split("content", "\n"), F.lit(1)).alias("line"))


@query("SELECT f AS facility, t AS document_type, 2::INT AS n_metrics FROM (VALUES ('general'), ('childrens'), ('regional')) a(f), (VALUES ('quality_report'), ('performance_dashboard')) b(t)")
def synthetic_reports(spark, sf_dir):
    return C.synthetic_reports(spark, "2024-05-31").select("facility", "document_type", F.size("metrics").alias("n_metrics"))
