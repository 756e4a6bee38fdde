"""Sections, headings, tables and chunks of documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwright.functions import money

# How the items of a filing are headed.
SECTIONS = {
    "item_1": [r"item\s+1\s*[.\-:]\s*business", r"item\s+1\s*$"],
    "item_1a": [r"item\s+1a\s*[.\-:]\s*risk\s+factors", r"item\s+1a\s*$"],
    "item_1b": [r"item\s+1b\s*[.\-:]\s*unresolved\s+staff", r"item\s+1b\s*$"],
    "item_2": [r"item\s+2\s*[.\-:]\s*properties", r"item\s+2\s*$"],
    "item_3": [r"item\s+3\s*[.\-:]\s*legal\s+proceedings", r"item\s+3\s*$"],
    "item_7": [r"item\s+7\s*[.\-:]\s*management['’s\s]+discussion", r"item\s+7\s*[.\-:]\s*md\s*&\s*a", r"item\s+7\s*$"],
    "item_7a": [r"item\s+7a\s*[.\-:]\s*quantitative\s+and\s+qualitative", r"item\s+7a\s*$"],
    "item_8": [r"item\s+8\s*[.\-:]\s*financial\s+statements", r"item\s+8\s*$"],
    "item_9": [r"item\s+9\s*[.\-:]\s*changes\s+in\s+and\s+disagreements", r"item\s+9\s*$"],
    "item_9a": [r"item\s+9a\s*[.\-:]\s*controls\s+and\s+procedures", r"item\s+9a\s*$"],
}


def boundaries(text: str) -> Iterator[tuple[str, str, int]]:
    """(type, title line, position) of every heading that no page number follows."""
    for kind, patterns in SECTIONS.items():
        for m in re.finditer("|".join(f"(?:{p})" for p in patterns), text, re.I | re.M):
            a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            b = len(text) if b < 0 else b
            if not text[b + 1 :].split("\n", 1)[0].strip().isdigit():
                yield kind, text[a:b].strip(), m.start()


def section_boundaries(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section_type, title, position of each type's first heading."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *b) for k, t in zip(pdf[key], pdf[text], strict=True) for b in boundaries(t or "")]
            yield pd.DataFrame(rows, columns=[key, "section_type", "title", "position"])

    found = df.select(key, text).mapInPandas(run, f"{key} {kind}, section_type string, title string, position int")
    return found.groupBy(key, "section_type").agg(F.min(F.struct("position", "title")).alias("b")).select(key, "section_type", "b.title", "b.position")


def sections(df: DataFrame, key: str, text: str = "text", least: int = 50) -> DataFrame:
    """key, section_type, title, start, end, content, length, word_count: from after the title line to the next heading; short ones dropped."""
    at = section_boundaries(df, key, text).join(df.select(key, text), key)
    w = Window.partitionBy(key).orderBy("position", "section_type")
    at = at.withColumn("end", F.coalesce(F.lead("position").over(w), F.length(text)))
    line = F.expr(f"locate('\\n', {text}, position + 1)")
    begin = F.when(line > 0, line).otherwise(F.col("position"))
    content = F.regexp_replace(F.substring(F.col(text), begin + 1, F.greatest(F.col("end") - begin, F.lit(0))), r"^\s+|\s+$", "")
    out = at.withColumn("content", content).withColumn("length", F.length("content")).filter(F.col("length") >= least)
    return out.select(key, "section_type", "title", F.col("position").alias("start"), "end", "content", "length", F.size(F.filter(F.split("content", r"\s+"), lambda x: x != "")).alias("word_count"))


# Sections by form, as captured on upper-cased text.
KEY_SECTIONS = {
    "10-K": {
        "business": r"(?:ITEM\s*1[\.\s]+BUSINESS|PART\s*I.*?ITEM\s*1)(.*?)(?=ITEM\s*1A|ITEM\s*2|$)",
        "risk_factors": r"(?:ITEM\s*1A[\.\s]+RISK\s*FACTORS)(.*?)(?=ITEM\s*1B|ITEM\s*2|$)",
        "mda": r"(?:ITEM\s*7[\.\s]+MANAGEMENT.*?DISCUSSION)(.*?)(?=ITEM\s*7A|ITEM\s*8|$)",
        "financials": r"(?:ITEM\s*8[\.\s]+FINANCIAL\s*STATEMENTS)(.*?)(?=ITEM\s*9|$)",
    },
    "10-Q": {
        "financials": r"(?:PART\s*I.*?ITEM\s*1[\.\s]+FINANCIAL)(.*?)(?=ITEM\s*2|$)",
        "mda": r"(?:ITEM\s*2[\.\s]+MANAGEMENT.*?DISCUSSION)(.*?)(?=ITEM\s*3|ITEM\s*4|$)",
    },
}


def key_sections(text: Column, form: Column, most: int = 15000, other: int = 10000) -> Column:
    """Map from section to text by form; other forms give the beginning as content."""
    out = F.create_map(F.lit("content"), F.substring(text, 1, other))
    for name, patterns in KEY_SECTIONS.items():
        # The capture keeps the original case: the pattern ignores it.
        made = [F.struct(F.lit(k).alias("key"), F.when(text.rlike("(?is)" + p), F.substring(F.regexp_extract(text, "(?is)" + p, 1), 1, most)).alias("value")) for k, p in patterns.items()]
        out = F.when(form == name, F.map_from_entries(F.filter(F.array(*made), lambda e: e["value"].isNotNull()))).otherwise(out)
    return out


# What a table's caption, header and first rows say about its type, in order of precedence.
TABLE_TYPES = {
    "balance_sheet": [r"balance\s+sheet", r"statement\s+of\s+financial\s+position", r"consolidated\s+balance\s+sheet", r"assets\s+and\s+liabilities"],
    "income_statement": [r"income\s+statement", r"statement\s+of\s+operations", r"statement\s+of\s+earnings", r"statement\s+of\s+comprehensive\s+income", r"consolidated\s+statements\s+of\s+operations", r"profit\s+and\s+loss"],
    "cash_flow": [r"cash\s+flow", r"statement\s+of\s+cash\s+flows", r"consolidated\s+statements\s+of\s+cash\s+flows"],
    "shareholders_equity": [r"shareholders.*equity", r"stockholders.*equity", r"statement\s+of\s+changes\s+in\s+equity", r"statement\s+of\s+stockholders.*equity"],
    "segment_reporting": [r"segment\s+information", r"segment\s+reporting", r"reportable\s+segment", r"geographic\s+information", r"net\s+sales\s+by\s+segment"],
    "revenue_breakdown": [r"revenue\s+by\s+product", r"net\s+sales\s+by\s+category", r"products\s+and\s+services", r"revenue\s+recognition"],
    "stock_compensation": [r"stock.*based\s+compensation", r"share.*based\s+compensation", r"stock\s+option", r"restricted\s+stock\s+units"],
    "debt_schedule": [r"term\s+debt", r"commercial\s+paper", r"debt\s+schedule", r"borrowings", r"notes\s+payable"],
    "lease_obligations": [r"lease\s+obligations", r"operating\s+lease", r"finance\s+lease", r"right.*of.*use\s+assets"],
}
PRIMARY = ("balance_sheet", "income_statement", "cash_flow", "shareholders_equity")
EXPECTED = {"balance_sheet": ("assets", "liabilities", "equity"), "income_statement": ("revenue", "expenses", "net_income"), "cash_flow": ("operating", "investing", "financing")}


def table_type(text: Column) -> Column:
    """Type of a table from its words; other if nothing fits."""
    t, out = F.lower(text), F.lit("other")
    for name, patterns in reversed(TABLE_TYPES.items()):
        out = F.when(t.rlike("|".join(patterns)), name).otherwise(out)
    return out


# How years, dates, periods and amounts are written in tables.
YEAR, DATE = r"\b(19|20)\d{2}\b", r"(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s*\d{4}"
PERIOD, AMOUNT = r"(?i)(years?|months?|quarters?)\s+(ended|ending)", r"^\$?[\(\-]?[\d,]+\.?\d*[\)]?$"
#: Digits behind a currency sign.
MONEY = r"[$€£¥]\s*[(\-]?\s*\d[\d,.]*"


def header_rows(rows: Column, strict_reference: bool = False) -> Column:
    """Number of header rows, 1 to 5: rows with years or periods before the first row of figures.

    An amount of money is no year ("$1999"); with strict_reference it may be one.
    """

    def is_date(c: Column) -> Column:
        year = c.rlike(YEAR) if strict_reference else c.rlike(YEAR) & F.regexp_replace(c, MONEY, "").rlike(YEAR)
        return year | c.rlike(DATE)

    def judge(row: Column) -> Column:
        cells = F.filter(F.transform(row, lambda c: F.trim(c)), lambda c: ~c.isin("", "—", "-"))
        dated = F.size(F.filter(cells, is_date))
        figures = F.size(F.filter(cells, lambda c: ~is_date(c) & ~c.rlike(PERIOD) & c.rlike(AMOUNT)))
        n = F.size(cells)
        data = (figures >= n * 0.5) | ((dated == 0) & (figures > 0))
        return F.when(n == 0, "blank").when(data, "stop").when((dated > 0) | F.array_join(row, " ").rlike(PERIOD), "header").otherwise("stop")

    kinds = F.transform(F.slice(rows, 1, 5), judge)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("found"), F.lit(True).alias("open"))
    fold = F.aggregate(kinds, start, lambda s, k: F.struct((s["at"] + 1).alias("at"), F.when(s["open"] & (k == "header"), s["at"] + 1).otherwise(s["found"]).alias("found"), (s["open"] & (k != "stop")).alias("open")))
    return F.when(F.size(rows) < 2, 1).otherwise(F.greatest(F.lit(1), fold["found"]))


def process_tables(tables: DataFrame, values: bool = False, strict_reference: bool = False) -> DataFrame:
    """Adds table_id, headers, data_rows, header_count, table_type, periods and the sections that a statement should have; values parses every cell."""
    t = tables.withColumn("header_count", header_rows(F.col("rows"), strict_reference))
    t = t.withColumn("headers", F.get("rows", F.col("header_count") - 1)).withColumn("data_rows", F.slice("rows", F.col("header_count") + 1, F.greatest(F.size("rows") - F.col("header_count"), F.lit(0))))
    words = F.concat_ws(" ", F.col("caption"), F.array_join("headers", " "), F.array_join(F.flatten(F.slice("data_rows", 1, 3)), " "))
    t = t.withColumn("table_type", table_type(words)).withColumn("table_id", F.concat(F.lit("table_"), (F.col("position") + 1).cast("string")))
    first = F.concat_ws(" ", F.col("caption"), F.array_join(F.get("data_rows", F.lit(0)), " "))
    t = t.withColumn("periods", F.reverse(F.array_sort(F.array_distinct(F.regexp_extract_all(first, F.lit(r"\b(20\d{2})\b"), F.lit(1))))))
    expected = F.lit(None).cast("array<string>")
    for name, parts in EXPECTED.items():
        expected = F.when(F.col("table_type") == name, F.array(*map(F.lit, parts))).otherwise(expected)
    t = t.withColumn("expected_sections", expected)
    return t.withColumn("values", money.parse_table(F.col("data_rows"), F.col("caption"), strict_reference)) if values else t


def primary_statements(processed: DataFrame, key: str) -> DataFrame:
    """The first table of each primary statement of each document, one row a document."""
    p = processed.filter(F.col("table_type").isin(*PRIMARY))
    return p.groupBy(key).pivot("table_type", list(PRIMARY)).agg(F.min_by("table_id", "position"))


ROMAN = frozenset("IVX")


def _heading(line: str) -> tuple[str, int] | None:
    """(heading, level) if a line is one: up to three signs, a number with a capitalised title, or an ITEM or PART with one."""
    line = line.rstrip()
    signs = len(line) - len(line.lstrip("#"))
    if signs:
        title = line[signs:]
        return (title.strip(), signs) if signs <= 3 and title[:1].isspace() and title.strip() else None
    first, _, rest = line.partition(" ")
    rest = rest.strip()
    if not rest or line[0].isspace() or "." in rest.removeprefix(rest.split()[0]):
        return None
    if all(part.isdecimal() for part in first.split(".")):
        return (f"{first} {rest}", first.count(".") + 1) if "A" <= rest[0] <= "Z" and "." not in rest else None
    number, _, title = rest.partition(" ")
    number = number[:-1] if number[-1] in ".:" else number
    counted = number.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").isdecimal() and sum(map(str.isalpha, number)) <= 1
    if first.upper() in ("ITEM", "PART") and title.strip()[:1].isalpha() and (counted or ROMAN.issuperset(number.upper())):
        return line, 1
    return None


def outline(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, int]]]:
    """Headings (position, heading, level), and (start, end) of runs of three or more rows between pipes, in one pass over the lines."""
    found, regions, run, at = [], [], [], 0
    for line in [*text.splitlines(keepends=True), ""]:
        bar = line.rstrip("\r\n")
        if len(bar) > 2 and bar[0] == bar[-1] == "|":
            run.append((at, at + len(line)))
        else:
            if len(run) >= 3:
                regions.append((run[0][0], run[-1][1]))
            run = []
            if (h := _heading(bar)) is not None:
                found.append((at, *h))
        at += len(line)
    return found, regions


def headings(text: str) -> list[tuple[int, str, int]]:
    """(position, heading, level) of every heading line; a heading is one line."""
    return outline(text)[0]


def table_regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of literal HTML tables and of three or more rows between pipes."""
    lower, out, at = text.lower(), [], 0
    while (start := lower.find("<table", at)) >= 0:
        end = lower.find("</table", start)
        close = lower.find(">", end) if end >= 0 else -1
        if close < 0:
            break
        if not lower[start + 6 : start + 7].isalnum():
            out.append((start, close + 1))
            at = close + 1
        else:
            at = start + 6
    return out + outline(text)[1]


def blank_tokens(text: str) -> int:
    return len(text.split())


class Chunker:
    """Splits a document at its headings, and long sections at sentences.

    A section of up to ``most`` tokens is one chunk. Longer ones fill chunks with sentences up to ``target``, each beginning
    with the last sentences of the one before, up to ``overlap`` tokens; a sentence over ``most`` is cut into words. With
    ``strict_reference`` the text before the first heading is lost and a chunk without text may stand before a long sentence.
    """

    def __init__(self, count: Callable[[str], int] = blank_tokens, target: int = 300, most: int = 400, overlap: int = 50, strict_reference: bool = False):
        self.count, self.target, self.most, self.overlap, self.strict = count, target, most, overlap, strict_reference

    def _parts(self, text: str) -> Iterator[tuple[int, int, str | None]]:
        marks = headings(text)
        if not marks:
            yield 0, len(text), None
            return
        if not self.strict and text[: marks[0][0]].strip():
            yield 0, marks[0][0], None
        ends = [*[m[0] for m in marks[1:]], len(text)]
        for (a, title, _), b in zip(marks, ends, strict=True):
            yield a, b, title

    def _pack(self, pieces: list[tuple[str, int]], limit: int, overlap: int) -> Iterator[tuple[str, int]]:
        """Greedy packs of (text, tokens) with what stays of a pack in the next."""
        held: list[tuple[str, int]] = []
        for p in pieces:
            if sum(n for _, n in held) + p[1] > limit and (held or self.strict):
                yield " ".join(t for t, _ in held), sum(n for _, n in held)
                stay, size = [], 0
                for q in reversed(held):
                    if size + q[1] > overlap:
                        break
                    stay, size = [q, *stay], size + q[1]
                held = stay if overlap else []
            held.append(p)
        if held:
            yield " ".join(t for t, _ in held), sum(n for _, n in held)

    def _long(self, text: str) -> Iterator[tuple[str, int]]:
        sentences = [(s, self.count(s)) for s in map(str.strip, re.split(r"(?<=[.!?])\s+", text)) if s]
        run: list[tuple[str, int]] = []
        for s, n in sentences:
            if n <= self.most:
                run.append((s, n))
                continue
            yield from self._pack(run, self.target, self.overlap)
            run = []
            yield from self._pack([(w, self.count(w)) for w in s.split()], self.most, 0)
        yield from self._pack(run, self.target, self.overlap)

    def chunks(self, text: str, doc_id: str) -> list[dict]:
        regions, out = table_regions(text), []
        for a, b, title in self._parts(text):
            whole = text[a:b]
            n = self.count(whole)
            table = any(a <= s and e <= b for s, e in regions)
            made = [(whole, n)] if n <= self.most else list(self._long(whole))
            start = a
            for content, tokens in made:
                i = len(out)
                digest = hashlib.md5(content.encode()).hexdigest()[:8]
                out.append({"chunk_id": f"{doc_id}_chunk_{i}_{digest}", "position": i, "content": content, "chunk_type": "table" if table and n <= self.most else "text", "token_count": tokens, "start_char": start, "end_char": start + len(content), "heading": title})
                start += len(content)
        return out


CHUNK = "chunk_id string, position int, content string, chunk_type string, token_count int, start_char int, end_char int, heading string"


def chunk_documents(df: DataFrame, key: str, text: str = "text", chunker: Chunker | None = None) -> DataFrame:
    """Chunks of every document; other columns go along."""
    chunker = chunker or Chunker()

    @F.pandas_udf(f"array<struct<{CHUNK.replace(', ', ',').replace(' ', ':')}>>")
    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([chunker.chunks(t or "", str(i)) for i, t in zip(ids, texts, strict=True)])

    made = df.withColumn("_c", F.explode(run(F.col(key), F.col(text))))
    return made.select(*[c for c in df.columns if c != text], "_c.*")


def budget_chunks(content: str, size: int = 500, share: float = 0.2) -> list[dict]:
    """Word chunks of at least ``size`` characters that begin with the last ``share`` of the words before; ids from the content."""
    out, held, chars = [], [], 0

    def add() -> None:
        text = " ".join(held)
        out.append({"chunk_id": hashlib.sha256(text.encode()).hexdigest()[:16], "text": text, "word_count": len(held), "char_count": len(text)})

    for w in content.split():
        held.append(w)
        chars += len(w) + 1
        if chars >= size:
            add()
            keep = int(len(held) * share)
            held = held[-keep:] if keep else []
            chars = sum(len(x) + 1 for x in held)
    if held:
        add()
    return out


# What makes a line of a page a heading.
def heading_level(line: Column) -> Column:
    """Level 1 to 6 of a heading line of a page; null for other lines."""
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*\.?)\s*[A-Z]", 1)
    depth = F.size(F.filter(F.split(number, r"\."), lambda p: p != ""))
    upper = line.rlike(r"^[A-Z][A-Z\s]+$") & (F.length(line) < 100)
    return F.when(number != "", F.least(F.greatest(depth, F.lit(1)), F.lit(6))).when(upper | line.rlike(r"^Item\s+\d+[A-Z]?\.\s+") | line.rlike(r"^Part\s+[IVX]+"), 1)


def table_is_valid(rows: Column, least_rows: int = 2, least_columns: int = 2) -> Column:
    """Enough rows and columns, and at most half of the cells empty."""
    cells = F.size(rows) * F.size(F.get(rows, F.lit(0)))
    empty = F.size(F.filter(F.flatten(rows), lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""))
    return F.coalesce((F.size(rows) >= least_rows) & (F.size(F.get(rows, F.lit(0))) >= least_columns) & (empty <= cells * 0.5), F.lit(False))


def markdown(rows: Column) -> Column:
    """A table as Markdown; the first row is the head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit(" --- ")), "|"), F.lit("|"))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n"))


# Names of companies, their tickers and keys.
COMPANIES = (
    ("apple", "Apple Inc.", "AAPL", "0000320193"), ("apple inc", "Apple Inc.", "AAPL", "0000320193"), ("microsoft", "Microsoft Corporation", "MSFT", "0000789019"),
    ("microsoft corp", "Microsoft Corporation", "MSFT", "0000789019"), ("amazon", "Amazon.com, Inc.", "AMZN", "0001018724"), ("amazon.com", "Amazon.com, Inc.", "AMZN", "0001018724"),
    ("alphabet", "Alphabet Inc.", "GOOGL", "0001652044"), ("google", "Alphabet Inc.", "GOOGL", "0001652044"), ("meta", "Meta Platforms, Inc.", "META", "0001326801"),
    ("facebook", "Meta Platforms, Inc.", "META", "0001326801"), ("tesla", "Tesla, Inc.", "TSLA", "0001318605"), ("nvidia", "NVIDIA Corporation", "NVDA", "0001045810"),
    ("jp morgan", "JPMorgan Chase & Co.", "JPM", "0000019617"), ("jpmorgan", "JPMorgan Chase & Co.", "JPM", "0000019617"),
)


def link_companies(df: DataFrame, name: str) -> DataFrame:
    """Adds official_name, ticker, cik of a company name, its legal suffix stripped; null if unknown."""
    key = F.lower(F.trim(F.col(name)))
    for suffix in (" inc.", " inc", " corp.", " corp", " corporation", " ltd.", " ltd", " llc"):
        key = F.trim(F.regexp_replace(key, suffix.replace(".", r"\.") + "$", ""))
    dim = df.sparkSession.createDataFrame(COMPANIES, "_key string, official_name string, ticker string, cik string")
    return df.withColumn("_k", key).join(F.broadcast(dim), F.col("_k") == F.col("_key"), "left").drop("_k", "_key")  # a fixed list


ENTITY = "text string, label string, start int, end int, confidence double"


def entity_rows(df: DataFrame, key: str, text: str = "text", model: Callable[[str], list[tuple[str, str, int, int, float]]] | None = None) -> DataFrame:
    """key, text, label, start, end, confidence, value: the model's entities, if one is given, and the amounts and percentages outside them, by start."""
    kind = dict(df.dtypes)[key]
    patterns = (("MONEY", re.compile(money.MONEY)), ("PERCENT", re.compile(money.PERCENT)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                own = list(model(t or "")) if model else []
                spans = [e[2:4] for e in own]
                for label, p in patterns:
                    own += [(m[0], label, *m.span(), 0.95) for m in p.finditer(t or "") if not any(a <= m.start() and m.end() <= b for a, b in spans)]
                rows += [(k, *e) for e in sorted(own, key=lambda e: e[2])]
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in ENTITY.split(", ")]])

    found = df.select(key, text).mapInPandas(run, f"{key} {kind}, {ENTITY}")
    return found.withColumn("value", F.when(F.col("label") == "MONEY", money.money_value(F.col("text"))).when(F.col("label") == "PERCENT", money.percent_value(F.col("text"))))
