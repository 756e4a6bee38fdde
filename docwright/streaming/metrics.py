"""Streaming forms: rates, counts by bucket, alert holds and monthly budgets, and a file stream that ends with what is there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docwright.operators import metrics as M

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def file_stream(spark: SparkSession, path: str, schema: str = EVENT, ts: str = "ts") -> DataFrame:
    """Events from the Parquet files of a folder. Watermarks need a zoned timestamp, so ts is cast under the session's zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def rate(events: DataFrame, keys: list[str], every: str = "5 minutes", seconds: float = 300.0, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events a second by window and key; windows close ``late`` after their end."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n", (F.col("n") / seconds).alias("rate"))


def histogram(events: DataFrame, keys: list[str], value: str = "value", every: str = "1 hour", late: str = "10 minutes", bounds=M.BOUNDS, ts: str = "ts") -> DataFrame:
    """Cumulative counts by window and key: an array of struct(le, n), ready for ``quantile``."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    g = events.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(*counts, F.count(value).alias("_all"))
    h = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").cast("double").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").cast("double").alias("n")))
    return g.select(F.col("window.start").alias("window_start"), *keys, h.alias("h"))


def quantile(histograms: DataFrame, q: float) -> DataFrame:
    return histograms.withColumn("value", M._quantile(q, F.col("h"))).drop("h")


def _expires(t, zone: str, seconds: int) -> int:
    """Milliseconds of the epoch ``seconds`` after a local time of the session's zone, as state timeouts want them."""
    return int(pd.Timestamp(t).tz_localize(zone, ambiguous=True, nonexistent="shift_forward").timestamp() + seconds) * 1000


def alert_hold(ticks: DataFrame, key: str, ts: str, firing: str, hold_seconds: int, late: str = "10 minutes", idle_seconds: int = 86400) -> DataFrame:
    """key, since, fires_at: once for each stretch on which the boolean ``firing`` held for hold_seconds.

    State of a key: the beginning of its stretch and whether it fired. Ticks of a batch are taken in time order; a tick
    older than the newest one seen, without a time, or later than ``late`` is ignored. A key that is silent for
    ``idle_seconds`` (and never less than the hold) loses its state, which ends its stretch.
    """
    kind, zone = dict(ticks.dtypes)[key], ticks.sparkSession.conf.get("spark.sql.session.timeZone")
    idle = max(idle_seconds, hold_seconds)

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, fired, newest = state.get if state.exists else (None, False, None)
        out = []
        for t, on in pd.concat(frames).sort_values(ts)[[ts, firing]].itertuples(index=False):
            if newest is not None and t <= pd.Timestamp(newest):
                continue
            newest = t
            if not on:
                since, fired = None, False
                continue
            since = t if since is None or pd.isna(since) else since
            if not fired and (t - pd.Timestamp(since)).total_seconds() >= hold_seconds:
                fired = True
                out.append((*k, since, pd.Timestamp(since) + pd.Timedelta(seconds=hold_seconds)))
        state.update((since, fired, newest))
        state.setTimeoutTimestamp(_expires(newest, zone, idle))
        yield pd.DataFrame(out, columns=[key, "since", "fires_at"])

    ticks = ticks.filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    return ticks.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, since timestamp, fires_at timestamp", "since timestamp, fired boolean, newest timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def monthly_spend(events: DataFrame, tenant: str, ts: str, cost: str) -> DataFrame:
    """tenant, month, spent after each batch: the state of a tenant restarts with a new month; late costs of a month that is over are left out of the new one.

    Events without a time, or more than 31 days late, are ignored; a tenant without events for 62 days loses its state.
    """
    kind, zone = dict(events.dtypes)[tenant], events.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        month, spent = state.get if state.exists else ("", 0.0)
        pdf = pd.concat(frames)
        by = pdf.groupby(pdf[ts].dt.strftime("%Y-%m"))[cost].sum().sort_index()
        for m, c in by.items():
            if m > month:
                month, spent = m, 0.0
            if m == month:
                spent += float(c)
        state.update((month, spent))
        state.setTimeoutTimestamp(_expires(pdf[ts].max(), zone, 62 * 86400))
        yield pd.DataFrame([(*k, month, spent)], columns=[tenant, "month", "spent"])

    events = events.filter(F.col(ts).isNotNull()).withWatermark(ts, "31 days")
    return events.groupBy(tenant).applyInPandasWithState(run, f"{tenant} {kind}, month string, spent double", "month string, spent double", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and ends; files and offsets make a rerun go on where it stopped."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
