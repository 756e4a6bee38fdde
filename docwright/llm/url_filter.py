"""URL filter by empirical-Bayes host reputation, in DataFrame expressions only.

Labelled page outcomes (good or not) are counted by host. Each level's prior is the level above: suffix under the global
rate, registered domain (last two labels) under its suffix, host under its domain. A level's prior strength comes from the
data, by the moments of a beta-binomial. A host is blocked when the upper bound of its posterior good rate is below
``min_good``; explicit rules go first.

Edge cases: a null url, or one without ``://``, has the empty host and path and is judged as the host ''. Repeated pages
count once for each row; several label rows of one page count as its worst outcome. With no labels the prior is 1/2 with
the least strength, and nothing is blocked but by rules. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
Z, MIN_GOOD, WEAKEST, STRONGEST = 1.645, 0.5, 1.0, 1000.0


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and every subdomain when the path starts with the rule's path. Equal lengths: allow wins, then the rule given last.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame) -> DataFrame:
    """One row: total, good rate m and prior strength k of groups (n, g), by the analysis-of-variance estimator."""
    s = groups.filter("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("N"),
        F.coalesce(F.sum("g"), F.lit(0)).cast("double").alias("G"),
        F.count(F.lit(1)).cast("double").alias("c"),
        F.coalesce(F.sum(F.col("g") * F.col("g") / F.col("n")), F.lit(0.0)).alias("gg"),
        F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("nn"),
    )
    m = (F.col("G") + 1) / (F.col("N") + 2)
    s = s.withColumn("m", m)
    within = F.col("m") * (1 - F.col("m"))
    tau = F.try_divide(F.col("gg") - F.try_divide(F.col("G") * F.col("G"), F.col("N")) - (F.col("c") - 1) * within, F.col("N") - F.try_divide(F.col("nn"), F.col("N")))
    rho = F.greatest(tau / within, F.lit(0.0))
    k = F.coalesce(F.when(rho > 0, (1 - rho) / rho), F.lit(STRONGEST))
    return s.select("m", F.round(F.least(F.greatest(k, F.lit(WEAKEST)), F.lit(STRONGEST)), 6).alias("k"))


def host_reputation(labelled: DataFrame, z: float = Z) -> DataFrame:
    """host, n, g, mean and upper bound of the good rate for every host of ``labelled`` (host, good; good may be null)."""
    hosts = labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("g"))
    return _shrink(hosts, z)


def _shrink(hosts: DataFrame, z: float) -> DataFrame:
    parts = F.split("host", r"\.")
    hosts = hosts.withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")).withColumn("suffix", F.element_at(parts, -1))
    total = lambda df, key: df.groupBy(key).agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    domains = total(hosts, ["domain", "suffix"])
    suffixes = total(domains, "suffix")
    at = lambda df, i: _strength(df).select(F.col("m").alias(f"m{i}"), F.col("k").alias(f"k{i}"))
    # Each of these has one row: a global aggregate's size is proven.
    priors = F.broadcast(at(suffixes, 0).crossJoin(at(domains, 1)).crossJoin(at(hosts, 2)))
    suffixes = suffixes.crossJoin(priors).select("suffix", ((F.col("g") + F.col("k0") * F.col("m0")) / (F.col("n") + F.col("k0"))).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").crossJoin(priors).select("domain", ((F.col("g") + F.col("k1") * F.col("suffix_mean")) / (F.col("n") + F.col("k1"))).alias("domain_mean"))
    a, b = F.col("g") + F.col("k2") * F.col("domain_mean"), F.col("n") - F.col("g") + F.col("k2") * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    return hosts.join(domains, "domain").crossJoin(priors).select("host", "n", "g", mean.alias("good_rate"), (mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("upper"))


def _strength_sql(groups: str, i: int) -> str:
    m = "((G + 1) / (N + 2))"
    within = f"({m} * (1 - {m}))"
    rho = f"greatest((gg - G * G / nullif(N, 0) - (c - 1) * {within}) / nullif(N - nn / nullif(N, 0), 0) / {within}, 0.0)"
    sums = f"SELECT coalesce(sum(n), 0)::DOUBLE AS N, coalesce(sum(g), 0)::DOUBLE AS G, count(*)::DOUBLE AS c, coalesce(sum(g::DOUBLE * g / n), 0) AS gg, coalesce(sum(n::DOUBLE * n), 0) AS nn FROM {groups} WHERE n > 0"
    return f"SELECT {m} AS m{i}, round(least(greatest(CASE WHEN {rho} > 0 THEN (1 - {rho}) / {rho} ELSE {STRONGEST}::DOUBLE END, {WEAKEST}::DOUBLE), {STRONGEST}::DOUBLE), 6) AS k{i} FROM ({sums})"


def oracle_sql(rules=RULES, z: float = Z, min_good: float = MIN_GOOD) -> str:
    """DuckDB SQL for page_id, host, path, rule, verdict over the tables pages and labels."""
    fits = [(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN", h + p, v) for v, h, p in reversed(sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")))]
    rule, verdict = (" ".join(f"{when} '{r[k]}'" for when, *r in fits) for k in (0, 1))
    return rf"""WITH seen AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcome AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
counted AS (SELECT host, string_split(host, '.') AS p, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS g FROM seen LEFT JOIN outcome USING (page_id) GROUP BY 1),
hosts AS (SELECT host, n, g, array_to_string(list_slice(p, greatest(len(p) - 1, 1), len(p)), '.') AS domain, list_extract(p, -1) AS suffix FROM counted),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(g)::BIGINT AS g FROM hosts GROUP BY 1, 2), suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(g)::BIGINT AS g FROM domains GROUP BY 1),
priors AS (SELECT * FROM ({_strength_sql("suffixes", 0)}), ({_strength_sql("domains", 1)}), ({_strength_sql("hosts", 2)})),
s AS (SELECT suffix, (g + k0 * m0) / (n + k0) AS above FROM suffixes, priors), d AS (SELECT domain, (g + k1 * above) / (n + k1) AS mean FROM domains JOIN s USING (suffix), priors),
h AS (SELECT host, g + k2 * mean AS a, n - g + k2 * (1 - mean) AS b FROM hosts JOIN d USING (domain), priors), r AS (SELECT host, a / (a + b) + {z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS upper FROM h)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE CASE WHEN upper < {min_good} THEN 'block' ELSE 'allow' END END AS verdict FROM seen LEFT JOIN r USING (host)"""


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, z: float = Z, min_good: float = MIN_GOOD) -> DataFrame:
    """page_id, host, path, rule, verdict, good_rate, upper for every page.

    ``labels`` has (doc_id, quality, toxic); a page's outcome is the row of its own id, good when quality is 1 and toxic
    is not. Pages are read for two columns only, shuffled by host once and joined to one row for each host; Spark splits
    the partitions of hot hosts, since both sides are written tables.
    """
    scratch = Scratch(pages.sparkSession, "url")
    seen = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    outcome = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    hosts = seen.join(outcome, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("g"))
    hosts = scratch.table(hosts, "hosts")
    reputation = scratch.table(_shrink(hosts, z), "reputation")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return (
        seen.join(reputation.select("host", "good_rate", "upper"), "host", "left")
        .withColumn("hit", rule)
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.when(F.col("upper") < min_good, "block").otherwise("allow")).alias("verdict"), "good_rate", "upper")
    )
