"""HTML, structure, chunk and entity queries over pages and documents; literal filings are put around or behind whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from docwright.functions import text as T
from docwright.operators import structure as S
from docwright.sources import html as H

from .registry import query, table

TABLE_HTML = """<div><p><b>CONSOLIDATED STATEMENTS OF OPERATIONS</b></p></div><div><table><tr><th></th><th colspan="2">Years ended</th></tr>
<tr><td></td><td>September 28, 2024</td><td>September 30, 2023</td></tr><tr><td>Net sales</td><td>${page_id}</td><td>$383,285</td></tr><tr></tr><tr><td>Loss</td><td>(1,234)</td><td>12.5%</td></tr></table></div>
<h3>Consolidated balance sheet</h3><table><tr><td>Assets</td><td>2024</td></tr><tr><td>Cash</td><td>29,943</td></tr></table><table><caption>Term debt</caption><tr><td>Notes</td><td>1</td></tr></table>"""
#: The text of a document stands in its first section.
FILING = "Contents\nItem 1. Business\n4\nItem 1A. Risk Factors\n9\n\nItem 1. Business\nWe design and sell devices, software and services to customers in many countries.\n{text}\nItem 1A. Risk Factors\nOur business can be harmed by events that we do not control, as described below.\nItem 7. Management's Discussion\nshort\nItem 8. Financial Statements\nThe consolidated statements that follow were prepared under the rules that apply.\n"


@query()
def page_text_clean(spark, sf_dir):
    return H.clean_column(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


@query()
def page_text_parsed(spark, sf_dir):
    return H.clean_column(table(spark, sf_dir, "pages").select("page_id", "html"), parser="page_text").select("page_id", "text")


@query("SELECT page_id, 'Firm ' || page_id AS company_name, lpad(page_id::VARCHAR, 10, '0') AS cik, '20240131' AS filing_date, NULL::VARCHAR AS form_type FROM pages")
def page_metadata(spark, sf_dir):
    header = F.concat(F.lit("<p>COMPANY CONFORMED NAME: Firm "), "page_id", F.lit("</p><p>CENTRAL INDEX KEY: "), "page_id", F.lit("</p><p>FILED AS OF DATE: 20240131</p>"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", header).alias("html"))
    return H.metadata_column(p).select("page_id", "metadata.company_name", "metadata.cik", "metadata.filing_date", "metadata.form_type")


def _tables(spark, sf_dir):
    before, after = TABLE_HTML.split("{page_id}")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit(before), F.col("page_id").cast("string"), F.lit(after)).alias("html"))
    return S.process_tables(H.table_rows(p, "page_id"), values=True)


@query("""SELECT page_id, p::INT AS position, t AS table_type, h::INT AS header_count, r::INT AS data_rows FROM pages, (VALUES (0, 'income_statement', 2, 2), (1, 'balance_sheet', 1, 1), (2, 'debt_schedule', 1, 0)) v(p, t, h, r)""")
def tables_processed(spark, sf_dir):
    return _tables(spark, sf_dir).select("page_id", "position", "table_type", "header_count", F.size("data_rows").alias("data_rows"))


@query("""SELECT page_id, 'table_2' AS balance_sheet, 'table_1' AS income_statement, NULL::VARCHAR AS cash_flow, NULL::VARCHAR AS shareholders_equity FROM pages""")
def primary_statements(spark, sf_dir):
    return S.primary_statements(_tables(spark, sf_dir), "page_id")


@query("""SELECT page_id, c::INT AS cell, (CASE c WHEN 1 THEN page_id ELSE v END)::DOUBLE AS value, t AS value_type FROM pages, (VALUES (0, NULL, 'text'), (1, 0, 'currency'), (2, 383285, 'currency')) x(c, v, t)""")
def table_values(spark, sf_dir):
    v = _tables(spark, sf_dir).filter("position = 0").select("page_id", F.posexplode(F.get("values", F.lit(0))).alias("cell", "v"))
    return v.select("page_id", "cell", F.col("v.value").cast("double").alias("value"), "v.value_type")


N_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(f"""SELECT doc_id, s AS section_type, (CASE s WHEN 'item_1' THEN w + {N_WORDS} ELSE w END)::INT AS word_count FROM documents, (VALUES ('item_1', 13), ('item_1a', 15), ('item_8', 12)) v(s, w)""")
def sections(spark, sf_dir):
    before, after = FILING.split("{text}")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(before), "text", F.lit(after)).alias("text"))
    return S.sections(d, "doc_id").select("doc_id", "section_type", "word_count")


RISK = r"substr(regexp_extract('Item 1A. Risk Factors' || text || ' Item 2', '(?is)ITEM\s*1A[\.\s]+RISK\s*FACTORS(.*?)(?:ITEM\s*1B|ITEM\s*2)', 1), 1, 15000)"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'content' ELSE 'risk_factors' END AS name, CASE WHEN doc_id % 2 = 0 THEN substr('Item 1A. Risk Factors' || text || ' Item 2', 1, 10000) ELSE {RISK} END AS section FROM documents""")
def key_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Item 1A. Risk Factors"), "text", F.lit(" Item 2")).alias("t"))
    m = S.key_sections(F.col("t"), F.when(F.col("doc_id") % 2 == 0, "8-K").otherwise("10-K"))
    return d.select("doc_id", F.explode(m).alias("name", "section"))


@query()
def semantic_chunks(spark, sf_dir):
    return S.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


@query()
def semantic_chunks_strict(spark, sf_dir):
    return S.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", chunker=S.Chunker(strict_reference=True))


@query()
def document_headings(spark, sf_dir):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *h) for k, t in zip(pdf["doc_id"], pdf["text"], strict=True) for h in S.headings(t or "")], columns=["doc_id", "position", "heading", "level"])

    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Report\n1.2 Overview of it\nITEM 7. Discussion\n"), "text").alias("text"))
    return d.mapInPandas(run, "doc_id long, position int, heading string, level int")


@query()
def budget_chunks(spark, sf_dir):
    @F.pandas_udf("array<struct<chunk_id:string,text:string,word_count:int,char_count:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: S.budget_chunks(t or ""))

    return table(spark, sf_dir, "documents").select("doc_id", F.explode(run("text")).alias("c")).select("doc_id", "c.*")


FOUND = r"""d AS (SELECT doc_id, text || ' paid $' || n_chars || 'K at 7.5% a year' AS t FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?i)[$€£¥]\s*[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|trillion|thousand|M|B|T|K)\b)?')) AS text FROM d),
u AS (SELECT *, lower(trim(regexp_replace(text, '[$€£¥,]', '', 'g'))) AS t FROM m),
e AS (SELECT doc_id, 'MONEY' AS label, text, TRY_CAST(regexp_extract(t, '^(\d+(?:\.\d+)?)', 1) AS DOUBLE) * CASE
WHEN regexp_extract(t, '([a-z]+)$', 1) IN ('trillion', 't') THEN 1e12 WHEN regexp_extract(t, '([a-z]+)$', 1) IN ('billion', 'b') THEN 1e9 WHEN regexp_extract(t, '([a-z]+)$', 1) IN ('million', 'm') THEN 1e6 WHEN regexp_extract(t, '([a-z]+)$', 1) IN ('thousand', 'k') THEN 1e3 ELSE 1.0 END::DOUBLE AS value FROM u
UNION ALL SELECT doc_id, 'PERCENT', p, TRY_CAST(trim(replace(p, '%', '')) AS DOUBLE) FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\d+(?:\.\d+)?\s*%')) AS p FROM d))"""


def found_entities(spark, sf_dir):
    """Entities of every document's whole text, with an amount and a share at its end."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" paid $"), "n_chars", F.lit("K at 7.5% a year")).alias("text"))
    return S.entity_rows(d, "doc_id")


@query(f"WITH {FOUND} SELECT doc_id, label, text, value FROM e")
def entity_union(spark, sf_dir):
    return found_entities(spark, sf_dir).select("doc_id", "label", "text", "value")


@query(f"WITH {FOUND} SELECT label, count(*) AS n FROM e GROUP BY 1")
def entity_counts(spark, sf_dir):
    return entity_union(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'JPM' END AS ticker FROM customer")
def company_link(spark, sf_dir):
    n = F.col("c_custkey") % 3
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(n == 0, "Apple Inc.").when(n == 1, "JPMorgan").otherwise(F.col("c_name")).alias("name"))
    return S.link_companies(c, "name").select("c_custkey", "ticker")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END::INT AS level, CASE p_partkey % 4 WHEN 0 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 |  |' ELSE '' END AS markdown, p_partkey % 4 = 0 AS valid FROM part")
def pdf_parts(spark, sf_dir):
    n = F.col("p_partkey") % 4
    line = F.when(n == 0, "1.1 Overview").when(n == 1, "RISK FACTORS").when(n == 2, "Part II").otherwise("plain text")
    rows = F.when(n == 0, F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("")))).otherwise(F.array().cast("array<array<string>>"))
    return table(spark, sf_dir, "part").select("p_partkey", S.heading_level(line).alias("level"), S.markdown(rows).alias("markdown"), S.table_is_valid(rows).alias("valid"))


@query("""SELECT doc_id, round((least(25, 2 * 5) + least(25, n * 5) + least(25, 3 * 3) + CASE WHEN w BETWEEN 100 AND 5000 THEN 25 WHEN w > 50 THEN 15 ELSE 0 END) / 100.0, 2)::DOUBLE AS score FROM (SELECT doc_id, doc_id % 7 AS n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM documents)""".replace("\\\\s", "\\s"))
def healthcare_quality(spark, sf_dir):
    from docwright.operators.growth import healthcare_quality as score

    return table(spark, sf_dir, "documents").select("doc_id", score(F.lit(2), F.col("doc_id") % 7, F.lit(3), F.size(T.words(F.col("text")))).alias("score"))
