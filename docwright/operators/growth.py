"""Growth between fiscal periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.functions import money


def year_over_year(df: DataFrame, keys: Sequence[str], year: str, quarter: str, value: str, how=money.growth) -> DataFrame:
    """Adds prior and growth against the same quarter of the year before; a gap gives null, never a wrong partner."""
    prior = df.select(*keys, (F.col(year) + 1).alias(year), quarter, F.col(value).alias("prior"))
    return df.join(prior, [*keys, year, quarter], "left").withColumn("growth", how(F.col(value), F.col("prior")))


def quarter_over_quarter(df: DataFrame, keys: Sequence[str], year: str, quarter: str, value: str, how=money.growth) -> DataFrame:
    """Adds prior and growth against the quarter just before, across years."""
    ordinal = F.col(year) * 4 + F.col(quarter)
    prior = df.select(*keys, (ordinal + 1).alias("_ordinal"), F.col(value).alias("prior"))
    return df.withColumn("_ordinal", ordinal).join(prior, [*keys, "_ordinal"], "left").drop("_ordinal").withColumn("growth", how(F.col(value), F.col("prior")))


def silver_quality(ticker: Column, period_end: Column, text: Column, failed: Column) -> Column:
    """0.2 for each of ticker, period end, text, text over 1000 characters, and no errors."""
    point = lambda c: F.when(F.coalesce(c, F.lit(False)), 0.2).otherwise(0.0)
    has = lambda c: c.isNotNull() & (c != "")
    return F.round(point(has(ticker)) + point(has(period_end)) + point(has(text)) + point(F.length(text) > 1000) + point(~failed), 6)


# Words that count as financial content.
QUALITY_WORDS = ("revenue", "income", "assets", "cash", "earnings", "profit")


def script_quality(text: Column, form: Column) -> Column:
    """0.5, a bonus for length, 0.03 for each financial word up to 0.2, 0.1 for annual and quarterly forms; at most 1."""
    t = F.lower(text)
    words = sum((F.when(F.contains(t, F.lit(w)), 1).otherwise(0) for w in QUALITY_WORDS), F.lit(0))
    length = F.when(F.length(text) > 10000, 0.2).when(F.length(text) > 1000, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(0.5) + length + F.least(F.lit(0.2), words * 0.03) + F.when(form.isin("10-K", "10-Q"), 0.1).otherwise(0.0)), 6)


def healthcare_quality(n_sections: Column, n_entities: Column, n_metrics: Column, words: Column) -> Column:
    """Share of 100 points: 5 a section and an entity type, 3 a metric, each up to 25, and 25 or 15 for the length in words."""
    size = F.when(words.between(100, 5000), 25).when(words > 50, 15).otherwise(0)
    return F.round((F.least(F.lit(25), n_sections * 5) + F.least(F.lit(25), n_entities * 5) + F.least(F.lit(25), n_metrics * 3) + size) / 100, 2)


# Sector words.
TECHNOLOGY = ("apple", "microsoft", "google", "alphabet", "meta")


def sector(name: Column) -> Column:
    n = F.lower(name)
    tech = F.lit(False)
    for w in TECHNOLOGY:
        tech = tech | F.contains(n, F.lit(w))
    return F.when(tech, "Technology").when(F.contains(n, F.lit("amazon")), "Consumer Discretionary").otherwise("Technology")
