"""Relational building blocks: upserts, latest rows, ranks, caps, scans by directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; with ``rank`` their place is kept under that name."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def unprocessed(source: DataFrame, done: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows of source without their key in done, in order, at most limit."""
    return source.join(done.select(key), key, "left_anti").orderBy(*order).limit(limit)


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """target and the rows of batch with new keys; of rows with one key in the batch the first in order goes in."""
    return target.unionByName(first_per_key(batch, keys, order).join(target.select(*keys), list(keys), "left_anti"))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Inserts new keys; of keys that exist only the columns ``update`` take the batch's values.

    Of rows with one key in the batch the last in order counts, so ``order`` is given latest first.
    """
    new = first_per_key(batch, keys, order)
    t, b = target.alias("t").withColumn("_old", F.lit(True)), new.alias("b").withColumn("_new", F.lit(True))
    both = t.join(b, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys], "full")
    pick = []
    for c in target.columns:
        old, fresh = F.col(f"t.{c}"), F.col(f"b.{c}") if c in batch.columns else F.lit(None)
        if c in keys:
            pick.append(F.coalesce(old, fresh).alias(c))
        elif c in update:
            pick.append(F.when(F.col("_new"), fresh).otherwise(old).alias(c))
        else:
            pick.append(F.when(F.col("_old"), old).otherwise(fresh).alias(c))
    return both.select(*pick)


def lookup(df: DataFrame, dim: DataFrame, on: Column, default: dict[str, Column]) -> DataFrame:
    """Left join with a dimension; missing values take the defaults."""
    joined = df.join(dim, on, "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(c), d).alias(c) for c, d in default.items()])


def zero_fill(key: Column, width: int = 10) -> Column:
    """Left-fills with zeros and never cuts."""
    return F.when(F.length(key) >= width, key).otherwise(F.lpad(key, width, "0"))


def complete_directories(paths: DataFrame, path: str = "path", depth: int = 5, files: Sequence[str] = ("document.html", "metadata.json")) -> DataFrame:
    """Directories of ``depth`` parts that hold every one of the files."""
    parts = F.split(F.col(path), "/")
    found = paths.filter(F.size(parts) > depth).select(F.array_join(F.slice(parts, 1, depth), "/").alias("directory"), F.element_at(parts, -1).alias("file"))
    flags = [F.bool_or(F.col("file") == f).alias(f"_{i}") for i, f in enumerate(files)]
    return found.groupBy("directory").agg(*flags).filter(" and ".join(f"_{i}" for i in range(len(files)))).select("directory")


def object_key(prefix: Column, cik: Column, form: Column, accession: Column, name: str) -> Column:
    """Path of a stored document; the key loses leading zeros."""
    return F.concat_ws("/", prefix, F.lit("sec-edgar"), F.regexp_replace(cik, "^0+", ""), form, accession, F.lit(name))


def document_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """Download address: key without leading zeros, accession number without dashes."""
    return F.concat_ws("/", F.lit(base), F.regexp_replace(cik, "^0+", ""), F.regexp_replace(accession, "-", ""), document)


def containing(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str, run: int = 3) -> DataFrame:
    """key, text, item_key, item for every text that contains an item, found by shared runs of words.

    An item's words between blanks, but for the first and the last, stand whole in each text that contains it. One hashed run
    of ``run`` of them is joined with the runs of the texts, and what meets is checked. Items with fewer words between have no
    run and are looked for in every text: they are the short ones of a stated list. Nulls contain nothing and are in nothing;
    rows without a key are not found.
    """

    def runs(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - run + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, run), " ")))

    t, i = texts.select(key, text), items.filter(F.col(item).isNotNull()).select(item_key, item)
    words = F.split(F.col(item), " ")
    long = F.size(words) >= run + 2
    anchors = i.filter(long).select(item_key, F.array_min(runs(F.slice(words, 2, F.size(words) - 2))).alias("_anchor"))
    spread = t.withColumn("_words", F.split(F.col(text), " ")).filter(F.size("_words") >= run).select(key, F.explode(F.array_distinct(runs(F.col("_words")))).alias("_anchor"))
    met = spread.join(anchors, "_anchor").select(key, item_key).distinct()
    found = met.join(t, key).join(i.filter(long), item_key).filter(F.contains(text, F.col(item)))
    rest = t.join(i.filter(~long), F.contains(text, F.col(item)))
    return found.select(key, text, item_key, item).unionByName(rest.select(key, text, item_key, item))


def zip_arrays(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows from parallel arrays of one record."""
    z = F.explode(F.arrays_zip(*[F.col(c).alias(c.rsplit(".", 1)[-1]) for c in columns])).alias("z")
    return df.select(*keep, z).select(*keep, "z.*")


def nearest_rank(values: Column, p: float) -> Column:
    """Element min(int(n * p / 100), n - 1) of the sorted array, from 0; null if empty."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(F.floor(n * p / 100).cast("int"), n - 1))


def nearest_rank_by_key(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """The same by key for many rows: equal values are counted before the shuffle and their running count finds the rank."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    run = counted.withColumn("_to", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = lambda p: F.least(F.floor(F.col("_all") * p / 100).cast("long"), F.col("_all") - 1)
    return run.groupBy(*keys).agg(F.sum("_n").alias("n"), *[F.min(F.when(F.col("_to") > at(p), F.col(value))).alias(f"p{p:g}") for p in ps])
