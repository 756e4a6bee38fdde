"""Provenance over documents and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.operators import provenance as P

from .registry import query, table

PART = 2000
REGISTERED = "d AS (SELECT sha256(text) AS document_hash, min('doc://' || doc_id) AS source_url, max(length(text))::INT AS n_chars FROM documents GROUP BY 1)"
CHUNKS = f"""c AS (SELECT DISTINCT sha256(text) AS document_hash, sha256(substr(text, i * {PART} + 1, {PART})) AS chunk_hash
FROM (SELECT text, unnest(range(0, greatest(1, ((length(text) + {PART - 1}) // {PART})))) AS i FROM documents))"""


def registered(spark, sf_dir):
    return P.register_documents(table(spark, sf_dir, "documents"), F.concat(F.lit("doc://"), "doc_id"))


def chunks(spark, sf_dir):
    """Every document's whole text in parts of ``PART`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / PART).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * PART + 1, F.lit(PART)))
    return table(spark, sf_dir, "documents").filter("text is not null").select(F.sha2("text", 256).alias("document_hash"), F.explode(parts).alias("content")).distinct()


@query(f"WITH {REGISTERED} SELECT * FROM d")
def provenance_documents(spark, sf_dir):
    return registered(spark, sf_dir)


@query(f"WITH {REGISTERED}, {CHUNKS} SELECT chunk_hash, CASE WHEN source_url IS NULL THEN c.document_hash || '>' || chunk_hash ELSE source_url || '>' || c.document_hash || '>' || chunk_hash END AS chain FROM c LEFT JOIN d ON d.document_hash = c.document_hash")
def provenance_chain(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("chunk_hash", F.sha2("content", 256))
    return P.chains(c, registered(spark, sf_dir)).select("chunk_hash", F.array_join("chain", ">").alias("chain"))


@query(f"WITH {REGISTERED}, {CHUNKS} SELECT count(*) FILTER (WHERE d.document_hash IS NOT NULL) AS accepted, count(*) FILTER (WHERE d.document_hash IS NULL) AS orphans FROM c LEFT JOIN d ON d.document_hash = c.document_hash")
def provenance_audit(spark, sf_dir):
    ok, bad = P.register_chunks(chunks(spark, sf_dir), registered(spark, sf_dir))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(ok, "accepted").crossJoin(n(bad, "orphans"))


@query("SELECT sha256(text) AS input_hash, sha256(regexp_replace(text, '[0-9]', '#', 'g')) AS output_hash, 'mask' AS type FROM documents")
def provenance_transformations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return P.transformation(d, F.col("text"), F.regexp_replace("text", "[0-9]", "#"), "mask", {"digits": "#"}, F.lit("2024-01-01")).select("input_hash", "output_hash", "type")
