"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.llm import jaccard, packing, quality, substring
from docwright.llm.common import Scratch, release
from docwright.llm.queries import byte_pattern, table, vocabulary


def classify_quality(spark, docs, sf_dir):
    """Drops documents that the nearest-neighbour vote rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    """Keeps the first document of each class of five-word-shingle Jaccard similarity 0.8 or more."""
    return jaccard.keep_first(docs)


def drop_repeats(spark, docs, sf_dir):
    """Removes lines and sentences that an earlier document has; n_chars follows the text."""
    out = substring.dedup(docs, removed=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark, docs, sf_dir):
    """Pieces of every document with their sequence and offset."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), byte_pattern())


STAGES = [("quality", classify_quality), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("packing", pack_sequences)]

#: The classifier, the chosen paths and the tokenizer are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other over documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs, name)
            release(but=scratch)
    return docs
