"""Dashboard and alert expressions over series made from events: counters and a latency histogram, scraped each hour."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from docwright.operators import metrics as M

from . import promql
from .registry import query, table

HOUR = "1 hour"


def series(spark, sf_dir):
    """api_requests_total{route,status} and api_latency_seconds_bucket{route,le}, cumulative by hour, and the gauge api_value{route}."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    run = lambda keys: Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("ts")
    hourly = e.groupBy(F.col("event_type").alias("route"), status.alias("status"), "hour").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    labels = F.create_map(F.lit("route"), "route", F.lit("status"), "status")
    counter = hourly.select(F.lit("api_requests_total").alias("metric"), labels.alias("labels"), at, F.sum("n").over(run(["route", "status"])).cast("double").alias("value"))
    gauge = hourly.select(F.lit("api_value").alias("metric"), F.create_map(F.lit("route"), "route").alias("labels"), at, F.col("v").alias("value"))
    b = M.observe(e.select(F.col("event_type").alias("route"), "hour", "value"), ["route", "hour"], "value")
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    buckets = b.select(F.lit("api_latency_seconds_bucket").alias("metric"), F.create_map(F.lit("route"), "route", F.lit("le"), le).alias("labels"), at, F.sum("cumulative").over(run(["route", "le"])).cast("double").alias("value"))
    return counter.unionByName(gauge).unionByName(buckets)


def instants(spark, sf_dir, n=5):
    last = table(spark, sf_dir, "events").agg(F.date_trunc("hour", F.max("ts"))).first()[0]
    return [last - timedelta(days=k) for k in range(n)]


def run(spark, sf_dir, expression):
    at = [t if isinstance(t, datetime) else datetime.fromisoformat(str(t)) for t in instants(spark, sf_dir)]
    return promql.evaluate(expression, series(spark, sf_dir), at)


LAST = '''m AS (SELECT date_trunc('hour', max(ts))::TIMESTAMP AS last FROM events), a AS (SELECT last - to_days(k::INT) AS "at" FROM m, (SELECT unnest(range(0, 5)) AS k))'''
#: Increase over a day of a counter scraped each hour: events between the first and the last scrape in the window.
INC = """s AS (SELECT event_type AS route, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS t, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2, 3),
i AS (SELECT "at", route, status, sum(n) - arg_min(n, t) AS inc, count(*) AS k FROM a JOIN s ON t > "at" - INTERVAL 1 DAY AND t <= "at" GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


@query(f'''WITH {LAST}, {INC} SELECT "at", round(sum(inc) / 86400.0::DOUBLE, 9) AS value FROM i GROUP BY 1''')
def promql_rate(spark, sf_dir):
    return run(spark, sf_dir, "sum(rate(api_requests_total[1d]))").select(F.col("at").cast("timestamp_ntz").alias("at"), F.round("value", 9).alias("value"))


@query(f'''WITH {LAST}, {INC} SELECT "at", route, sum(inc)::DOUBLE AS value FROM i GROUP BY 1, 2''')
def promql_increase_by(spark, sf_dir):
    return run(spark, sf_dir, "sum by (route) (increase(api_requests_total[24h]))").select(F.col("at").cast("timestamp_ntz").alias("at"), promql.label("route").alias("route"), "value")


@query(f'''WITH {LAST}, {INC} SELECT "at", round(100.0 * (sum(inc) FILTER (WHERE status = '500') / 86400.0::DOUBLE) / (sum(inc) / 86400.0::DOUBLE), 9) AS value FROM i GROUP BY 1''')
def promql_error_ratio(spark, sf_dir):
    return run(spark, sf_dir, '100 * sum(rate(api_requests_total{status=~"5.*"}[1d])) / sum(rate(api_requests_total[1d]))').select(F.col("at").cast("timestamp_ntz").alias("at"), F.round("value", 9).alias("value"))


@query(f'''WITH {LAST}, {INC} SELECT "at", route, sum(inc)::DOUBLE AS value FROM i GROUP BY 1, 2 HAVING sum(inc) > 5''')
def promql_alert(spark, sf_dir):
    return run(spark, sf_dir, "sum(increase(api_requests_total[1d])) by (route) > 5").select(F.col("at").cast("timestamp_ntz").alias("at"), promql.label("route").alias("route"), "value")


@query(f"""WITH {LAST}, s AS (SELECT event_type AS route, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS t, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT "at", route, round(avg(v), 9) AS value FROM a JOIN s ON t > "at" - INTERVAL 7 DAYS AND t <= "at" GROUP BY 1, 2""")
def promql_avg_over_time(spark, sf_dir):
    return run(spark, sf_dir, "avg_over_time(api_value[7d])").select(F.col("at").cast("timestamp_ntz").alias("at"), promql.label("route").alias("route"), F.round("value", 9).alias("value"))


@query(f'''WITH {LAST} SELECT "at", 0.0::DOUBLE AS value FROM a''')
def promql_or_vector(spark, sf_dir):
    return run(spark, sf_dir, "sum(absent_metric) or vector(0)").select(F.col("at").cast("timestamp_ntz").alias("at"), "value")


@query()
def promql_histogram_quantile(spark, sf_dir):
    return run(spark, sf_dir, "histogram_quantile(0.95, sum(rate(api_latency_seconds_bucket[7d])) by (le))").select("at", "value")


@query(f'''WITH {LAST}, s AS (SELECT event_type AS route, event_type = 'error' AS bad, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS t, count(*) AS n FROM events GROUP BY 1, 2, 3),
w AS (SELECT "at", d, "at" - to_days(d::INT) AS upto FROM a, (SELECT unnest(range(0, 2)) AS d)),
i AS (SELECT "at", d, route, bad, sum(n) - arg_min(n, t) AS inc FROM w JOIN s ON t > upto - INTERVAL 1 DAY AND t <= upto GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),
r AS (SELECT "at", (sum(inc) FILTER (WHERE d = 0))::DOUBLE / nullif(sum(inc) FILTER (WHERE d = 1), 0)::DOUBLE AS v FROM i GROUP BY 1)
SELECT "at", round(v, 9) AS value FROM r WHERE v > 0.5''')
def promql_offset(spark, sf_dir):
    return run(spark, sf_dir, "sum(increase(api_requests_total[1d])) / sum(increase(api_requests_total[1d] offset 1d)) > 0.5").select(F.col("at").cast("timestamp_ntz").alias("at"), F.round("value", 9).alias("value"))
