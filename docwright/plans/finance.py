"""Financial time series over orders and line items, and values and periods as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.functions import money
from docwright.operators import growth as G

from .registry import query, table

REVENUE = """rev AS (SELECT year(o_orderdate)::INT AS fy, quarter(o_orderdate)::INT AS fq, sum((l_extendedprice::DECIMAL(18,2)) * (1 - l_discount::DECIMAL(18,2)))::DECIMAL(28,4) AS revenue,
sum(l_quantity::DECIMAL(18,2))::DECIMAL(28,4) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def revenue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("p"), F.col("l_discount").cast("decimal(18,2)").alias("d"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("fq")).agg(F.sum(F.col("p") * (1 - F.col("d"))).cast("decimal(28,4)").alias("revenue"), F.sum("q").cast("decimal(28,4)").alias("quantity"))


@query("WITH " + REVENUE + " SELECT fy, fq, revenue, quantity FROM rev")
def quarter_revenue(spark, sf_dir):
    return revenue(spark, sf_dir)


def rounded_growth(c, p):
    return F.round(money.growth(c.cast("double"), p.cast("double")), 9)


@query("WITH " + REVENUE + ", g AS (SELECT a.fy, a.fq, a.revenue, b.revenue AS prior FROM rev a LEFT JOIN rev b ON b.fy = a.fy - 1 AND b.fq = a.fq) SELECT *, round((revenue::DOUBLE - prior::DOUBLE) / nullif(prior::DOUBLE, 0), 9) AS growth FROM g")
def yoy_growth(spark, sf_dir):
    return G.year_over_year(revenue(spark, sf_dir).drop("quantity"), [], "fy", "fq", "revenue", rounded_growth)


@query("WITH " + REVENUE + ", g AS (SELECT a.fy, a.fq, a.revenue, b.revenue AS prior FROM rev a LEFT JOIN rev b ON b.fy * 4 + b.fq = a.fy * 4 + a.fq - 1) SELECT *, round((revenue::DOUBLE - prior::DOUBLE) / nullif(prior::DOUBLE, 0), 9) AS growth FROM g")
def qoq_growth(spark, sf_dir):
    return G.quarter_over_quarter(revenue(spark, sf_dir).drop("quantity"), [], "fy", "fq", "revenue", rounded_growth)


@query("WITH " + REVENUE + ", g AS (SELECT a.fy, a.fq, a.revenue::DOUBLE AS c, b.revenue::DOUBLE AS p FROM rev a JOIN rev b ON b.fy = a.fy - 1 AND b.fq = a.fq) SELECT fy, fq, round_even((c - p) / abs(p), 4) AS growth FROM g")
def growth_abs(spark, sf_dir):
    g = G.year_over_year(revenue(spark, sf_dir), [], "fy", "fq", "revenue", money.growth_abs)
    return g.filter(F.col("prior").isNotNull()).select("fy", "fq", F.col("growth").cast("double").alias("growth"))


@query("WITH " + REVENUE + " SELECT fy, fq, round_even(quantity::DOUBLE / nullif(revenue::DOUBLE, 0), 4) AS margin FROM rev")
def gross_margin(spark, sf_dir):
    return revenue(spark, sf_dir).select("fy", "fq", money.margin(F.col("quantity"), F.col("revenue")).cast("double").alias("margin"))


def _calendar(spark, month):
    q = spark.range(2015, 2026).select(F.col("id").cast("int").alias("fy")).crossJoin(spark.range(1, 5).select(F.col("id").cast("int").alias("fq")))
    p = q.select("fy", "fq", money.fiscal_quarter(F.col("fy"), F.col("fq"), month).alias("p"), money.fiscal_year(F.col("fy"), month).alias("y"), money.fiscal_half(F.col("fy"), F.ceil(F.col("fq") / 2).cast("int"), month).alias("h"))
    return p.select(F.lit(month).alias("end_month"), "fy", "fq", F.col("p.start").alias("q_start"), F.col("p.end").alias("q_end"), F.col("y.start").alias("y_start"), F.col("y.end").alias("y_end"), F.col("h.start").alias("h_start"), F.col("h.end").alias("h_end"), money.calendar_quarter(F.col("p.start"))["quarter"].alias("calendar_quarter"))


@query("""WITH m AS (SELECT unnest([12, 9, 6, 3])::INT AS end_month), y AS (SELECT unnest(range(2015, 2026))::INT AS fy), q AS (SELECT unnest([1, 2, 3, 4])::INT AS fq),
s AS (SELECT *, make_date(fy, end_month, 1) AS l FROM m, y, q),
t AS (SELECT *, (l + to_months((fq * 3 - 14)::INT))::DATE AS q_start, (l - INTERVAL 11 MONTHS)::DATE AS y_start, (l + to_months((ceil(fq / 2.0) * 6 - 17)::INT))::DATE AS h_start FROM s)
SELECT end_month, fy, fq, q_start, last_day((q_start + INTERVAL 2 MONTHS)::DATE) AS q_end, y_start, last_day(l) AS y_end, h_start, last_day((h_start + INTERVAL 5 MONTHS)::DATE) AS h_end, quarter(q_start)::INT AS calendar_quarter FROM t""")
def fiscal_calendar(spark, sf_dir):
    out = _calendar(spark, 12)
    for m in (9, 6, 3):
        out = out.union(_calendar(spark, m))
    return out


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS fy, quarter(o_orderdate)::INT AS fq FROM orders""")
def period_of_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", money.period_of_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("p"))
    return o.select("o_orderkey", F.col("p.year").alias("fy"), F.col("p.quarter").alias("fq"))


CELLS = "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '(' || l_extendedprice::DECIMAL(18,2) || ')' WHEN 1 THEN '$' || l_extendedprice::DECIMAL(18,2) WHEN 2 THEN l_tax::DECIMAL(18,2) || '%' WHEN 3 THEN l_shipmode_like WHEN 4 THEN l_quantity::BIGINT || '' END AS cell FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem)"


def _cells(spark, sf_dir):
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 5
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    cell = F.when(n == 0, F.concat(F.lit("("), text("l_extendedprice"), F.lit(")"))).when(n == 1, F.concat(F.lit("$"), text("l_extendedprice"))).when(n == 2, F.concat(text("l_tax"), F.lit("%"))).when(n == 3, F.concat("l_returnflag", "l_linestatus")).otherwise(F.col("l_quantity").cast("long").cast("string"))
    return li.select("l_orderkey", "l_linenumber", cell.alias("cell"))


@query(f"""WITH c AS ({CELLS}), v AS (SELECT *, try_cast(regexp_replace(cell, '[$(),%]', '', 'g') AS DOUBLE) AS n FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN cell LIKE '%\\%%' ESCAPE '\\' THEN 'percentage' WHEN n IS NULL THEN 'text' WHEN cell LIKE '$%' THEN 'currency' ELSE 'integer' END AS value_type,
CASE WHEN cell LIKE '(%' THEN -n ELSE n END AS value, CASE WHEN n IS NOT NULL AND cell NOT LIKE '%\\%%' ESCAPE '\\' THEN 'USD' END AS currency, cell LIKE '(%' AS is_negative FROM v""")
def parse_value(spark, sf_dir):
    v = _cells(spark, sf_dir).withColumn("v", money.cell_value(F.col("cell"), F.lit("(in millions)")))
    return v.select("l_orderkey", "l_linenumber", "v.value_type", F.col("v.value").cast("double").alias("value"), "v.currency", "v.is_negative")


@query(f"""WITH c AS ({CELLS}), v AS (SELECT *, try_cast(replace(regexp_extract(cell, '\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?|\\d+(\\.\\d+)?', 0), ',', '') AS DECIMAL(24,6)) AS n FROM c)
SELECT l_orderkey, l_linenumber, round((CASE WHEN cell LIKE '(%' THEN -n ELSE n END * 0.001)::DOUBLE, 9) AS millions FROM v""")
def gold_value(spark, sf_dir):
    return _cells(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(money.in_millions(F.col("cell"), F.lit("thousands")).cast("double"), 9).alias("millions"))


PERIOD_TEXT = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Three Months Ended March 31, ' || year(o_orderdate) + 20 WHEN 1 THEN 'Year Ended December 31, ' || year(o_orderdate) + 20
WHEN 2 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) + 20 ELSE 'H1 ' || year(o_orderdate) + 20 END AS t FROM orders"""


def _period_text(spark, sf_dir):
    n, y = F.col("o_orderkey") % 4, (F.year("o_orderdate") + 20).cast("string")
    t = F.when(n == 0, F.concat(F.lit("Three Months Ended March 31, "), y)).when(n == 1, F.concat(F.lit("Year Ended December 31, "), y)).when(n == 2, F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), y)).otherwise(F.concat(F.lit("H1 "), y))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))


@query(f"""WITH p AS ({PERIOD_TEXT}), y AS (SELECT *, try_cast(regexp_extract(t, '20\\d\\d') AS INT) AS fy FROM p)
SELECT o_orderkey, fy AS fiscal_year, CASE WHEN t LIKE 'Three%' THEN 1 END::INT AS fiscal_quarter, CASE WHEN t LIKE 'Three%' THEN 'Q1 ' || fy WHEN t LIKE 'Year%' THEN 'FY ' || fy END AS label FROM y""")
def period_parse(spark, sf_dir):
    return _period_text(spark, sf_dir).select("o_orderkey", money.reported_period(F.col("t")).alias("p")).select("o_orderkey", "p.*")


@query(f"""WITH p AS ({PERIOD_TEXT}), y AS (SELECT *, try_cast(regexp_extract(t, '20\\d\\d') AS INT) AS fy FROM p),
k AS (SELECT *, CASE WHEN t LIKE 'Three%' THEN 1 WHEN t LIKE 'Q%' THEN substr(t, 2, 1)::INT ELSE NULL END AS q FROM y)
SELECT o_orderkey, CASE WHEN q IS NOT NULL THEN 'quarterly' WHEN t LIKE 'Year%' THEN 'annual' ELSE 'semi_annual' END AS period_type, CASE WHEN q IS NOT NULL THEN 'Q' || q || ' ' || fy WHEN t LIKE 'Year%' THEN 'FY ' || fy ELSE 'H1 ' || fy END AS label,
CASE WHEN q IS NOT NULL THEN make_date(fy, q * 3 - 2, 1) ELSE make_date(fy, 1, 1) END AS "start", CASE WHEN q IS NOT NULL THEN last_day(make_date(fy, q * 3, 1)) WHEN t LIKE 'Year%' THEN make_date(fy, 12, 31) ELSE make_date(fy, 6, 30) END AS "end" FROM k""")
def period_extract(spark, sf_dir):
    p = _period_text(spark, sf_dir).select("o_orderkey", F.explode(money.periods_in(F.col("t"))).alias("p"))
    return p.select("o_orderkey", "p.period_type", "p.label", "p.start", "p.end")


AMOUNTS = "SELECT o_orderkey, 'Paid $' || round(o_totalprice / 1000, 1)::DECIMAL(12,1) || CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN ' thousand' ELSE ' to us' END || ' at ' || (o_orderkey % 50) || '.5%' AS t, o_orderkey % 3 AS k, round(o_totalprice / 1000, 1)::DECIMAL(12,1)::DOUBLE AS n, (o_orderkey % 50) + 0.5::DOUBLE AS p FROM orders"


@query(f"SELECT o_orderkey, round(n * CASE k WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 ELSE 1.0 END, 3) AS amount, p AS percent FROM ({AMOUNTS})")
def money_percent(spark, sf_dir):
    n = F.round(F.col("o_totalprice") / 1000, 1).cast("decimal(12,1)")
    k = F.col("o_orderkey") % 3
    t = F.concat(F.lit("Paid $"), n.cast("string"), F.when(k == 0, "M").when(k == 1, " thousand").otherwise(" to us"), F.lit(" at "), (F.col("o_orderkey") % 50).cast("string"), F.lit(".5%"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    return o.select("o_orderkey", F.round(money.money_value(F.get(money.money_in(F.col("t")), F.lit(0))), 3).alias("amount"), money.percent_value(F.get(money.percents_in(F.col("t")), F.lit(0))).alias("percent"))


WORDS = "('revenue'), ('income'), ('assets'), ('cash'), ('earnings'), ('profit')"


@query(f"""SELECT doc_id, round(least(1.0, 0.5 + CASE WHEN length(text) > 10000 THEN 0.2 WHEN length(text) > 1000 THEN 0.1 ELSE 0 END + least(0.2, 0.03 * (SELECT count(*) FROM (VALUES {WORDS}) w(k) WHERE contains(lower(text), k)))
+ CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS script, round(0.2 + CASE WHEN quality IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN text <> '' THEN 0.2 ELSE 0 END + CASE WHEN length(text) > 1000 THEN 0.2 ELSE 0 END
+ CASE WHEN coalesce(toxic, 0) = 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS silver FROM documents LEFT JOIN labels USING (doc_id)""")
def quality_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    form = F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("8-K")
    return d.select("doc_id", G.script_quality(F.col("text"), form).alias("script"), G.silver_quality(F.col("lang"), F.col("quality").cast("string"), F.col("text"), F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("silver"))
