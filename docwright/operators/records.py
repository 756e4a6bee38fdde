"""Smaller record operators: optional filters, probes, containment, consolidation, trends, exposition, injected parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docwright.functions import text as T
from docwright.operators.growth import script_quality, sector


def select_recent(df: DataFrame, order: Sequence[Column], limit: int, **equal) -> DataFrame:
    """Rows that equal every given value (None asks nothing), in order, at most limit."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df.orderBy(*order).limit(limit)


def title_contains(df: DataFrame, title: str, term: str) -> DataFrame:
    return df.filter(F.contains(F.lower(F.col(title)), F.lit(term.lower())))


def entities_of(df: DataFrame, labels: Sequence[str] | None = None, confidence: float | None = None) -> DataFrame:
    """Entity rows of the labels, with at least the confidence."""
    if labels is not None:
        df = df.filter(F.col("label").isin(*labels))
    return df if confidence is None else df.filter(F.col("confidence") >= confidence)


def require_valid(df: DataFrame, state: Column, most: float = 0.1) -> DataFrame:
    """n, n_invalid, ratio; an error if more than ``most`` of the rows are not 'valid'."""
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(state != "valid").alias("n_invalid"))
    ok = F.col("n_invalid") <= F.col("n") * most
    return g.select("n", "n_invalid", F.coalesce(F.try_divide(F.col("n_invalid").cast("double"), "n"), F.lit(0.0)).alias("ratio"), ok.alias("valid")).withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.lit("too many invalid embeddings")).cast("boolean")))


def table_counts(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """name, present, rows of tables or views."""
    out = None
    for n in names:
        here = spark.catalog.tableExists(n)
        row = spark.table(n).agg(F.count(F.lit(1)).alias("rows")) if here else spark.range(1).select(F.lit(None).cast("long").alias("rows"))
        row = row.select(F.lit(n).alias("name"), F.lit(here).alias("present"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Rows (key, inner start and end, outer start and end) of inner regions inside an outer one of the same key: an equi-join and two bounds."""
    i, o = inner.select(key, F.col("start").alias("i_start"), F.col("end").alias("i_end")), outer.select(key, F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    return i.join(o, key).filter((F.col("i_start") >= F.col("o_start")) & (F.col("i_end") <= F.col("o_end")))


def consolidate(entities: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """keys, label, sorted distinct values and their number; distinct before the lists are made."""
    d = entities.select(*keys, label, value).distinct()
    return d.groupBy(*keys, label).agg(F.array_sort(F.collect_list(value)).alias("values"), F.count(F.lit(1)).alias("n"))


def trend(series: DataFrame, keys: Sequence[str], bucket: str, value: str, seconds: int, factor: float = 1.5) -> DataFrame:
    """Adds past (the bucket just before, null after a gap) and failed: the value is over factor times it."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    at = F.unix_seconds(F.col(bucket).cast("timestamp"))
    past = F.when(at - F.lag(at).over(w) == seconds, F.lag(value).over(w))
    return series.withColumn("past", past).withColumn("failed", F.coalesce(F.col(value) > factor * F.col("past"), F.lit(False)))


def silver_projection(df: DataFrame, key: str, text: str, name: str, form: str) -> DataFrame:
    """Counts of paragraphs, the word table and financial words, sector by name and quality, as one projection."""
    t = F.lower(F.col(text))
    n = lambda p: F.regexp_count(t, F.lit(p))
    return df.select(key, (n("\n\n") + 1).alias("paragraphs"), n("table").alias("tables"), (n("revenue") > 0).alias("has_revenue"), sector(F.col(name)).alias("sector"), script_quality(F.col(text), F.col(form)).alias("quality"))


def mean_of_sum_count(samples: DataFrame, keys: Sequence[str], sum_name: str, count_name: str) -> DataFrame:
    """keys, mean from the two series of a histogram or summary."""
    pick = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")))
    return samples.filter(F.col("metric").isin(sum_name, count_name)).groupBy(*keys).agg(F.try_divide(pick(sum_name), pick(count_name)).alias("mean"))


def counters(events: DataFrame, keys: Sequence[str], amounts: dict[str, Column]) -> DataFrame:
    """A family of counters by labels in one aggregate: requests, then the sum of each amount."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(n) for n, c in amounts.items()])


def exposition(samples: DataFrame) -> DataFrame:
    """line: samples (metric, labels, value) in the text form that scrapers read."""
    quoted = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], '(["\\\\])', "\\\\$1"), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))).otherwise("")
    return samples.select(F.concat("metric", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def token_counts(df: DataFrame, text: str, count: Callable[[str], int] | None = None, out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens by an injected tokenizer; blank-separated words without one, inside generated code."""
    if count is None:
        return df.withColumn(out, F.coalesce(F.size(T.words(F.col(text))), F.lit(0)))

    @F.pandas_udf("int")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: count(t) if t else 0)

    return df.withColumn(out, run(F.col(text)))


def parse_binary(files: DataFrame, parser: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """path, page, text of files (path, content) by an injected parser, such as one for PDF; a file that it cannot read gives one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, n, t, None) for n, t in parser(bytes(content))]
                except Exception as e:  # noqa: BLE001  the row carries it
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def write_jdbc(df: DataFrame, url: str, name: str, batch: int = 100, **options) -> None:
    """Appends to a database table in batches of rows."""
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode("append").save()
