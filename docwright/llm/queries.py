"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_tree, chat, jaccard, lm_scoring, packing, quality, substring, url_filter, vector_dedup


def vocabulary(name: str) -> str:
    """Where the public vocabularies are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_bpe(spark, sf_dir):
    return bpe_tree.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_chat(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_vector_dedup(spark, sf_dir):
    return vector_dedup.find_links(table(spark, sf_dir, "embeddings"))


def op7_substring(spark, sf_dir):
    return substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), byte_pattern())


def op9_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_ann, op3_bpe, op4_chat, op5_jaccard, op6_vector_dedup, op7_substring, op8_packing, op9_quality, op10_url_filter)}
ORACLE_SQL = {"op4_chat": chat.ORACLE_SQL, "op10_url_filter": url_filter.oracle_sql()}
