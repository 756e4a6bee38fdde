"""Service metrics: rates, histograms, alert holds, budgets, traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Request latency bucket bounds, in seconds.
BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def status_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def rate(events: DataFrame, ts: str, keys: Sequence[str], every: str, seconds: float) -> DataFrame:
    """Events a second by key and window: window_start, keys, n, rate."""
    g = events.groupBy(F.window(ts, every)["start"].alias("window_start"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rate", F.col("n") / seconds)


def increase(samples: DataFrame, keys: Sequence[str], ts: str, value: str, bucket: Column, name: str = "increase") -> DataFrame:
    """Increase of a counter by key and bucket; after a reset the new value counts from zero. A sample's delta belongs to its own bucket."""
    w = Window.partitionBy(*keys).orderBy(ts)
    before = F.lag(value).over(w)
    delta = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("_d", delta).groupBy(*keys, bucket.alias("bucket")).agg(F.sum("_d").alias(name))


#: Blocks of time in a window of avg_over_time, and the least microseconds of a block.
BLOCKS, LEAST_BLOCK = 168, 60_000_000


def avg_over_time(samples: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Adds the mean over the seconds up to and with each sample.

    A sample enters a running sum at its time and leaves it once the seconds are over, so the work does not grow with the
    samples of a window. Time is cut into blocks, each begins with the sum of those before it, and a task sums a block of a key.
    """
    span = seconds * 1_000_000
    every = max(span // BLOCKS, LEAST_BLOCK)
    block = F.col("_at") - F.pmod("_at", F.lit(every))
    # Decimals sum to the same in any order.
    amount, n = F.col(value).cast("decimal(28,6)").cast("decimal(38,6)"), F.col(value).isNotNull().cast("long")
    own = samples.withColumns({"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_sum": amount, "_n": n}).withColumns({"_block": block, "_own": F.lit(True)})
    enter = own.select(*keys, "_at", "_sum", "_n").filter("_at IS NOT NULL")
    leave = enter.select(*keys, (F.col("_at") + span + 1).alias("_at"), (-F.col("_sum")).alias("_sum"), (-F.col("_n")).alias("_n"))
    totals = enter.union(leave).groupBy(*keys, block.alias("_block")).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, (F.col("_block") - 1).alias("_at"), F.sum("_sum").over(before).alias("_sum"), F.sum("_n").over(before).alias("_n"), "_block")
    moves = leave.withColumn("_block", block).unionByName(carry).withColumn("_own", F.lit(False))
    w = Window.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    total, count = F.sum("_sum").over(w).cast("double"), F.sum("_n").over(w)
    summed = own.unionByName(moves, allowMissingColumns=True).withColumn("avg_over_time", F.when(count > 0, total / count))
    return summed.filter("_own").drop("_at", "_sum", "_n", "_block", "_own")


def offset(series: DataFrame, keys: Sequence[str], bucket: str, value: str, by: str) -> DataFrame:
    """Adds ``past``: the value of the bucket that is ``by`` earlier, null if there is none."""
    past = series.select(*keys, (F.col(bucket) + F.expr(f"INTERVAL {by}")).alias(bucket), F.col(value).alias("past"))
    return series.join(past, [*keys, bucket], "left")


def surge(series: DataFrame, keys: Sequence[str], bucket: str, value: str, by: str, factor: float) -> DataFrame:
    """Buckets whose value is over factor times the one ``by`` earlier."""
    return offset(series, keys, bucket, value, by).filter(F.col(value) > factor * F.col("past"))


def observe(events: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """keys, le, cumulative: one pass over the events, one row a bound; the last bound is infinite."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(*keys).agg(*counts, F.count(value).alias("_all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("cumulative")))
    return wide.select(*keys, F.explode(rows).alias("b")).select(*keys, "b.*")


def histogram_quantile(q: float, histogram: DataFrame, keys: Sequence[str], le: str = "le", count: str = "cumulative") -> DataFrame:
    """keys, value: the quantile by linear interpolation inside the first bucket that reaches q of the total.

    In the infinite bucket the last finite bound is given; below the first bound interpolation begins at zero; an empty
    histogram gives null.
    """
    h = F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(count).cast("double").alias("n"))))
    g = histogram.groupBy(*keys).agg(h.alias("h"))
    return g.select(*keys, _quantile(q, F.col("h")).alias("value"))


def _quantile(q: float, h: Column) -> Column:
    total = F.element_at(h, -1)["n"]
    rank = total * q
    at = F.size(F.filter(h, lambda b: b["n"] < rank))
    low = F.when(at > 0, F.get(h, at - 1)["le"]).otherwise(F.lit(0.0))
    below = F.when(at > 0, F.get(h, at - 1)["n"]).otherwise(F.lit(0.0))
    b = F.get(h, at)
    inside = low + (b["le"] - low) * F.try_divide(rank - below, b["n"] - below)
    return F.when((F.size(h) == 0) | (total <= 0), None).when(b["le"] == float("inf"), F.get(h, F.size(h) - 2)["le"]).when((at == 0) & (b["le"] <= 0), b["le"]).otherwise(F.coalesce(inside, low))


def alert_hold(ticks: DataFrame, keys: Sequence[str], ts: str, condition: Column, hold_seconds: int) -> DataFrame:
    """keys, since, until, fires_at of each stretch of ticks on which the condition held for at least hold_seconds."""
    w = Window.partitionBy(*keys).orderBy(ts)
    marked = ticks.withColumn("_on", F.coalesce(condition, F.lit(False)))
    island = marked.withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_on").orderBy(ts)))
    runs = island.filter("_on").groupBy(*keys, "_run").agg(F.min(ts).alias("since"), F.max(ts).alias("until"))
    seconds = F.unix_seconds(F.col("until").cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp"))
    return runs.filter(seconds >= hold_seconds).select(*keys, "since", "until", (F.col("since") + F.expr(f"INTERVAL {hold_seconds} SECONDS")).alias("fires_at"))


def last_value(samples: DataFrame, keys: Sequence[str], ts: str, value: str, tie: str) -> DataFrame:
    """A gauge's newest value by key."""
    return samples.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


# Dollars for 1000 tokens, in and out, and the models that a budget state allows.
MODEL_RATES = {
    "gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "gpt-3.5-turbo": (0.0005, 0.0015),
    "claude-3-opus": (0.015, 0.075), "claude-3-sonnet": (0.003, 0.015), "claude-3-haiku": (0.00025, 0.00125),
}
ALLOWED = {
    "normal": ("gpt-4o", "gpt-4o-mini", "gpt-3.5-turbo", "claude-3-sonnet", "claude-3-haiku"),
    "warning": ("gpt-4o-mini", "gpt-3.5-turbo", "claude-3-haiku"),
    "critical": ("gpt-3.5-turbo", "claude-3-haiku"),
    "exhausted": (),
}


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a request; an unknown model costs nothing."""
    out = F.lit(0.0)
    for name, (a, b) in MODEL_RATES.items():
        out = F.when(model == name, tokens_in / 1000 * a + tokens_out / 1000 * b).otherwise(out)
    return out


def request_estimate(model: Column, tokens: Column) -> Column:
    return tokens / 1000 * F.when(F.contains(model, F.lit("gpt-4")), 0.002).otherwise(0.0015)


def budget_status(budget: Column, spent: Column, model: Column) -> Column:
    """struct(remaining, utilization, state, allowed, recommended) for a request for a model.

    States begin at 0.8 (warning), 0.9 (critical) and 1 (exhausted). A model that the state does not allow is replaced by
    the cheapest allowed one by output price, the first of equal ones.
    """
    use = F.when(budget > 0, F.least(F.lit(1.0), spent / budget)).otherwise(0.0)
    state = F.when(use >= 1, "exhausted").when(use >= 0.9, "critical").when(use >= 0.8, "warning").otherwise("normal")
    allowed, cheapest = F.lit(False), F.lit(None).cast("string")
    for name, models in ALLOWED.items():
        allowed = F.when(state == name, model.isin(*models) if models else F.lit(False)).otherwise(allowed)
        cheapest = F.when(state == name, F.lit(min(models, key=lambda m: MODEL_RATES[m][1]) if models else None)).otherwise(cheapest)
    return F.struct(F.greatest(F.lit(0.0), budget - spent).alias("remaining"), use.alias("utilization"), state.alias("state"), (allowed | cheapest.isNotNull()).alias("allowed"), F.when(~allowed, cheapest).alias("recommended"))


def trace_envelope(spans: DataFrame, trace: str, start: str, duration: str, service: str) -> DataFrame:
    """First start, last end, total and number of services of each trace."""
    g = spans.groupBy(trace).agg(F.min(start).alias("begins"), F.max(F.col(start) + F.col(duration)).alias("ends"), F.countDistinct(service).alias("services"))
    return g.withColumn("total", F.col("ends") - F.col("begins"))


def remediation(metric: Column, issue: Column) -> Column:
    """Which job an alert starts: a quality metric re-embeds, a chunk issue re-chunks."""
    return F.when(F.lower(metric).rlike("ndcg|recall|mrr|embedding"), "reembed").when(F.contains(F.lower(issue), F.lit("chunk")), "rechunk").otherwise("none")
