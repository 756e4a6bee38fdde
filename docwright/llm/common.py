"""Shared helpers: tables that cut lineage, row keys, text batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset in local mode (tests), a folder of our own is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder.

    A written table cuts the lineage, survives the loss of executors, and is read by every stage that follows, so nothing
    costly is computed twice. ``drop`` frees a table that no returned frame reads; ``release`` the tables of all operators.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _made.append(self)

    def table(self, df: DataFrame, label: str, by: str | None = None) -> DataFrame:
        """df, written and read; ``by`` names a column of few values with a folder each."""
        self.count += 1
        path = f"{self.root}/{self.count:02d}-{label}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docwright_path = path
        return out

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._docwright_path)

    def close(self) -> None:
        """Frees all tables; what was returned on top of them must have been written."""
        self._delete(self.root)


_made: list[Scratch] = []


def release(but: Scratch | None = None) -> None:
    """Frees the tables of all operators called so far, but for one; for callers that have written the results."""
    for s in [s for s in _made if s is not but]:
        s.close()
        _made.remove(s)


def row_key(df: DataFrame, key: str, text: str) -> Column:
    """A long for each distinct (key, text); nulls have values of their own."""
    return F.xxhash64(F.col(key).isNull(), F.col(key), F.col(text).isNull(), F.col(text))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def blocks_for(n_units: float, per_block: float, least: int = 1) -> int:
    """Number of blocks of about per_block units."""
    return max(least, int(-(-n_units // per_block)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __init__(self, most: int = 400_000):
        self.memo: dict = {}
        self.most = most

    def __call__(self, words: list) -> np.ndarray:
        import xxhash

        memo, digest = self.memo, xxhash.xxh3_64_intdigest
        if len(memo) > self.most:
            memo.clear()
        get = memo.get
        out = list(map(get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = memo[words[i]] = digest(words[i])
        return np.array(out, dtype=np.uint64)


def one_thread() -> None:
    """Keep numpy's libraries to one thread in a worker."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(k, "1")
