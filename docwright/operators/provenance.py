"""Registered documents and chunks, their transformations, and chains of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.functions.text import content_hash


def register_documents(docs: DataFrame, url: Column, text: str = "text") -> DataFrame:
    """document_hash, source_url, n_chars; the same content is registered once, with its first address."""
    d = docs.select(content_hash(F.col(text)).alias("document_hash"), url.alias("source_url"), F.length(text).alias("n_chars"))
    return d.groupBy("document_hash").agg(F.min("source_url").alias("source_url"), F.max("n_chars").alias("n_chars"))


def register_chunks(chunks: DataFrame, documents: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(accepted, orphans): chunks (document_hash, content) with a registered document get chunk_hash, the others are orphans."""
    c = chunks.withColumn("chunk_hash", content_hash(F.col(content)))
    known = documents.select("document_hash")
    return c.join(known, "document_hash", "left_semi"), c.join(known, "document_hash", "left_anti")


def transformation(df: DataFrame, before: Column, after: Column, kind: str, params: dict[str, str], at: Column) -> DataFrame:
    """Edges input_hash, output_hash, type, at, params, one for each change of content."""
    pairs = F.create_map(*[F.lit(x) for kv in params.items() for x in kv]) if params else F.create_map().cast("map<string,string>")
    return df.select(content_hash(before).alias("input_hash"), content_hash(after).alias("output_hash"), F.lit(kind).alias("type"), at.alias("at"), pairs.alias("params"))


def chains(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_hash, chain: address, document and chunk, or document and chunk if the document is not registered."""
    j = chunks.select("chunk_hash", "document_hash").join(documents.select("document_hash", "source_url"), "document_hash", "left")
    return j.select("chunk_hash", F.when(F.col("source_url").isNull(), F.array("document_hash", "chunk_hash")).otherwise(F.array("source_url", "document_hash", "chunk_hash")).alias("chain"))
