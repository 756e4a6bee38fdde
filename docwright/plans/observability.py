"""Service metrics over events: event_type is the route, value the latency, user_id the tenant."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.operators import metrics as M
from docwright.operators import relational as R

from .registry import query, table

CODE = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END"
CODE_COL = F.expr


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def code():
    return F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS n, count(*) / 300.0::DOUBLE AS rate FROM events GROUP BY 1, 2")
def request_rate(spark, sf_dir):
    return M.rate(events(spark, sf_dir), "ts", ["event_type"], "5 minutes", 300.0)


@query(f"SELECT ({CODE} // 100) || 'xx' AS status_class, count(*) AS n FROM events GROUP BY 1")
def status_class(spark, sf_dir):
    return events(spark, sf_dir).groupBy(M.status_class(code()).alias("status_class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, round(100.0::DOUBLE * count(*) FILTER (WHERE {CODE} >= 500) / nullif(count(*), 0), 9) AS error_percent FROM events GROUP BY 1")
def error_ratio(spark, sf_dir):
    g = events(spark, sf_dir).groupBy(F.window("ts", "1 hour")["start"].alias("hour"))
    return g.agg(F.round(F.try_divide(100.0 * F.count_if(code() >= 500), F.count(F.lit(1))), 9).alias("error_percent"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_quantiles(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p)), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(CASE WHEN i = least(n * 50 // 100, n - 1) THEN value END) AS p50, max(CASE WHEN i = least(n * 95 // 100, n - 1) THEN value END) AS p95, max(CASE WHEN i = least(n * 99 // 100, n - 1) THEN value END) AS p99 FROM s GROUP BY 1""")
def nearest_rank(spark, sf_dir):
    return R.nearest_rank_by_key(events(spark, sf_dir), ["event_type"], "value", [50, 95, 99])


BOUNDS = "(VALUES " + ", ".join(f"({b})" for b in M.BOUNDS) + ", ('inf'::DOUBLE)) b(le)"


@query(f"SELECT event_type, le::DOUBLE AS le, count(*) FILTER (WHERE value <= le) AS cumulative FROM events, {BOUNDS} GROUP BY 1, 2")
def histogram_buckets(spark, sf_dir):
    return M.observe(events(spark, sf_dir), ["event_type"], "value")


@query(f"""WITH h AS (SELECT event_type, le::DOUBLE AS le, count(*) FILTER (WHERE value <= le)::DOUBLE AS n FROM events, {BOUNDS} GROUP BY 1, 2),
w AS (SELECT *, lag(le, 1, 0.0) OVER (PARTITION BY event_type ORDER BY le) AS lo, lag(n, 1, 0.0) OVER (PARTITION BY event_type ORDER BY le) AS below, max(n) OVER (PARTITION BY event_type) AS total FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS rn FROM w WHERE n >= 0.95 * total)
SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95 * total - below) / (n - below) END, 9) AS value FROM f WHERE rn = 1""")
def histogram_quantile(spark, sf_dir):
    h = M.observe(events(spark, sf_dir), ["event_type"], "value")
    return M.histogram_quantile(0.95, h, ["event_type"]).withColumn("value", F.round("value", 9))


DAILY = "d AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1, 2)"


def daily(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 day")["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DAILY} SELECT a.event_type, a.bucket, a.n, b.n AS past FROM d a LEFT JOIN d b ON b.event_type = a.event_type AND b.bucket + INTERVAL 1 DAY = a.bucket")
def offset_compare(spark, sf_dir):
    return M.offset(daily(spark, sf_dir), ["event_type"], "bucket", "n", "1 DAY").select("event_type", "bucket", "n", "past")


@query(f"WITH {DAILY} SELECT a.event_type, a.bucket, a.n, b.n AS past FROM d a JOIN d b ON b.event_type = a.event_type AND b.bucket + INTERVAL 1 DAY = a.bucket WHERE a.n > 1.1 * b.n")
def surge(spark, sf_dir):
    return M.surge(daily(spark, sf_dir), ["event_type"], "bucket", "n", "1 DAY", 1.1).select("event_type", "bucket", "n", "past")


@query("SELECT event_id, round((sum(value::DECIMAL(28,6)) OVER w)::DOUBLE / count(value) OVER w, 6) AS avg_over_time FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)")
def avg_over_time(spark, sf_dir):
    means = M.avg_over_time(events(spark, sf_dir), ["event_type"], "ts", "value", 7 * 86400)
    # As SQL rounds: a mean of half a digit stays one where division leaves it an ulp below.
    return means.select("event_id", (F.round(F.col("avg_over_time") * 1e6) / 1e6).alias("avg_over_time"))


@query("""WITH s AS (SELECT user_id, ts, event_id, (event_id % 1000)::DOUBLE AS c FROM events), d AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM s)
SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket, sum(CASE WHEN p IS NULL THEN 0 WHEN c < p THEN c ELSE c - p END) AS increase FROM d GROUP BY 1, 2""")
def counter_increase(spark, sf_dir):
    s = events(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), "ts", (F.col("event_id") % 1000).cast("double").alias("c"))
    return M.increase(s, ["user_id"], "at", "c", F.date_trunc("day", "ts").cast("timestamp_ntz"))


TICKS = "t AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS tick, avg(value) AS v FROM events GROUP BY 1, 2)"


@query(f"""WITH {TICKS}, m AS (SELECT *, v > 40 AS o FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY tick) - row_number() OVER (PARTITION BY event_type, o ORDER BY tick) AS run FROM m),
g AS (SELECT event_type, min(tick) AS since, max(tick) AS until FROM r WHERE o GROUP BY event_type, run)
SELECT event_type, since, until, since + INTERVAL 2 HOURS AS fires_at FROM g WHERE until - since >= INTERVAL 2 HOURS""")
def alert_hold(spark, sf_dir):
    t = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour")["start"].alias("tick")).agg(F.avg("value").alias("v"))
    return M.alert_hold(t, ["event_type"], "tick", F.col("v") > 40, 7200)


MODEL = "CASE event_type WHEN 'click' THEN 'gpt-4o' WHEN 'view' THEN 'gpt-4o-mini' WHEN 'purchase' THEN 'claude-3-opus' WHEN 'signup' THEN 'claude-3-haiku' ELSE 'other' END"
RATES = "(VALUES ('gpt-4o', 0.005, 0.015), ('gpt-4o-mini', 0.00015, 0.0006), ('claude-3-opus', 0.015, 0.075), ('claude-3-haiku', 0.00025, 0.00125)) r(model, a, b)"
SPENT = f"""c AS (SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS month, round(sum(round(coalesce(value * 10 / 1000 * a + value / 1000 * b, 0), 9)::DECIMAL(20,9))::DOUBLE, 6) AS cost
FROM (SELECT *, {MODEL} AS model FROM events) LEFT JOIN {RATES} USING (model) GROUP BY 1, 2)"""


def spent(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("model", F.expr(MODEL))
    cost = F.round(M.token_cost(F.col("model"), F.col("value") * 10, F.col("value")), 9).cast("decimal(20,9)")
    return e.groupBy("user_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum(cost).cast("double"), 6).alias("cost"))


@query(f"WITH {SPENT} SELECT user_id, month, round(cost, 4) AS cost FROM c")
def tenant_cost(spark, sf_dir):
    return spent(spark, sf_dir).withColumn("cost", F.round("cost", 4))


@query("""WITH c AS (SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS month, count(*)::DOUBLE AS spent FROM events GROUP BY 1, 2), u AS (SELECT *, least(1.0, spent / 20.0) AS utilization FROM c),
s AS (SELECT *, CASE WHEN utilization >= 1 THEN 'exhausted' WHEN utilization >= 0.9 THEN 'critical' WHEN utilization >= 0.8 THEN 'warning' ELSE 'normal' END AS state FROM u)
SELECT user_id, month, greatest(0.0, 20.0 - spent)::DOUBLE AS remaining, utilization::DOUBLE AS utilization, state, state <> 'exhausted' AS allowed, CASE state WHEN 'warning' THEN 'gpt-4o-mini' WHEN 'critical' THEN 'claude-3-haiku' END AS recommended FROM s""")
def budget_state(spark, sf_dir):
    c = events(spark, sf_dir).groupBy("user_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("spent"))
    return c.select("user_id", "month", M.budget_status(F.lit(20.0), F.col("spent"), F.lit("gpt-4o")).alias("b")).select("user_id", "month", "b.*")


@query("""SELECT event_type, quantile_cont(value, 0.95) < 100 AS p95_ok, count(*) FILTER (WHERE value > 150) < 0.01 * count(*) AS error_ok, count(*) FILTER (WHERE value <= 150) >= 0.99 * count(*) AS success_ok FROM events GROUP BY 1""")
def slo_validation(spark, sf_dir):
    n = F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("event_type").agg((F.percentile("value", F.lit(0.95)) < 100).alias("p95_ok"), (F.count_if(F.col("value") > 150) < 0.01 * n).alias("error_ok"), (F.count_if(F.col("value") <= 150) >= 0.99 * n).alias("success_ok"))


@query("SELECT user_id, min(event_id) AS begins, max(event_id + value::BIGINT) AS ends, count(DISTINCT event_type) AS services, max(event_id + value::BIGINT) - min(event_id) AS total FROM (SELECT user_id, event_id, floor(value) AS value, event_type FROM events) GROUP BY 1")
def trace_envelope(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("d", F.floor("value"))
    return M.trace_envelope(e, "user_id", "event_id", "d", "event_type")


@query("SELECT event_type, count(*) FILTER (WHERE value < 100) AS ok, round(100.0 * count(*) FILTER (WHERE value < 100) / count(*))::DOUBLE AS success_percent, round(avg(CASE WHEN value < 100 THEN value END), 6) AS avg_ok FROM events GROUP BY 1")
def warmup_stats(spark, sf_dir):
    ok = F.col("value") < 100
    return events(spark, sf_dir).groupBy("event_type").agg(F.count_if(ok).alias("ok"), F.round(100.0 * F.count_if(ok) / F.count(F.lit(1))).alias("success_percent"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("avg_ok"))


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def gauge_last(spark, sf_dir):
    return M.last_value(events(spark, sf_dir), ["event_type"], "ts", "value", "event_id")


@query("SELECT coalesce(sum(value) FILTER (WHERE event_type = 'absent'), 0.0)::DOUBLE AS value, round(avg(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END), 6) AS mean_or_zero FROM events")
def default_vector(spark, sf_dir):
    return events(spark, sf_dir).agg(F.coalesce(F.sum(F.when(F.col("event_type") == "absent", F.col("value"))), F.lit(0.0)).alias("value"), F.round(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0)), 6).alias("mean_or_zero"))


@query("SELECT event_type, CASE WHEN event_type IN ('error', 'click') THEN 'reembed' WHEN event_type = 'view' THEN 'rechunk' ELSE 'none' END AS job FROM (SELECT DISTINCT event_type FROM events)")
def event_routing(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type").distinct()
    metric = F.when(F.col("event_type").isin("error", "click"), "NDCG@10").otherwise("latency")
    return e.select("event_type", M.remediation(metric, F.when(F.col("event_type") == "view", "Chunk size").otherwise("")).alias("job"))
