"""HTML: a small element tree, cleaned text, metadata and tables.

Parsing has no expression form, so these run as Arrow functions over batches; the regex forms in functions.text stay in
generated code for plain needs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that are dropped, void, or break lines.
DROPPED = frozenset("script style noscript iframe embed object applet link meta head".split())
UNWANTED = frozenset("script style meta link".split())
BREAKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
NAVIGATION = re.compile("nav|menu|header|footer", re.I)
#: The bound that HTML puts on colspan.
MOST_COLUMNS = 1000
#: An opening tag ends these open elements.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"div", "td", "th", "body", "section", "article", "li"}, "option": {"select"}}


class Element:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict, parent: Element | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """Elements below, in the order of the page; pages may be deeper than Python's stack."""
        open_ = [iter(self.children)]
        while open_:
            c = next(open_[-1], None)
            if c is None:
                open_.pop()
            elif isinstance(c, Element):
                yield c
                open_.append(iter(c.children))

    def find_all(self, *names: str) -> Iterator[Element]:
        return (e for e in self.walk() if e.name in names)

    def texts(self) -> Iterator[str]:
        open_ = [iter(self.children)]
        while open_:
            c = next(open_[-1], None)
            if c is None:
                open_.pop()
            elif isinstance(c, str):
                yield c
            else:
                open_.append(iter(c.children))

    def text(self) -> str:
        """Stripped strings joined without anything between."""
        return "".join(s for s in map(str.strip, self.texts()) if s)

    def before(self) -> Iterator[Element | str]:
        """Siblings before this one, nearest first."""
        if self.parent is not None:
            at = next(i for i, c in enumerate(self.parent.children) if c is self)
            yield from reversed(self.parent.children[:at])


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends, scope = CLOSES.get(tag, set()), SCOPE.get(tag, set())
        e, close = self.at, None
        while ends and e.parent is not None and e.name not in scope:
            if e.name in ends:
                close = e
            e = e.parent
        if close is not None:
            self.at = close.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None:
            if e.name == tag:
                self.at = e.parent
                return
            e = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def prune(root: Element, gone) -> None:
    todo = [root]
    while todo:
        e = todo.pop()
        e.children = [c for c in e.children if isinstance(c, str) or not gone(c)]
        todo += [c for c in e.children if isinstance(c, Element)]


def normalize(text: str) -> str:
    """Compatibility form, then plain characters for typographic ones."""
    from docwright.functions.text import REPLACEMENTS

    text = unicodedata.normalize("NFKC", text)
    for old, new in REPLACEMENTS:
        text = text.replace(old, new)
    return text


def tidy(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", re.sub(" {2,}", " ", text).replace("\t", " "))
    return "\n".join(map(str.strip, text.split("\n")))


def clean(html: str | None) -> str:
    """Text of a page without dropped elements, hidden ones and boilerplate lines."""
    from docwright.functions.text import BOILERPLATE

    root = parse(html)
    prune(root, lambda e: e.name in DROPPED or re.search(r"display:\s*none", e.attrs.get("style", ""), re.I))
    text = normalize(" ".join(root.texts()))
    bad = re.compile("|".join(BOILERPLATE), re.I)
    text = "\n".join(s for s in text.split("\n") if not bad.search(s) and len(s.strip()) >= 3)
    return tidy(text).strip()


def page_text(html: str | None, tables: bool = True, breaks: bool = True) -> str:
    """Text of a page without scripts and navigation, with line breaks after blocks."""
    root = parse(html)
    prune(root, lambda e: e.name in UNWANTED or NAVIGATION.search(e.attrs.get("class", "")) or (not tables and e.name == "table"))
    if breaks:
        for e in list(root.walk()):
            if e.name in BREAKS:
                e.children.append("\n")
    text = re.sub(" +", " ", ("" if breaks else " ").join(root.texts()))
    text = re.sub(r"\n\s*\n\s*\n+", "\n\n", text)
    return "\n".join(map(str.strip, text.split("\n"))).strip()


# Labels of a filing's header.
LABELS = {"company_name": "COMPANY CONFORMED NAME:", "cik": "CENTRAL INDEX KEY:", "form_type": "CONFORMED SUBMISSION TYPE:", "filing_date": "FILED AS OF DATE:", "fiscal_year_end": "FISCAL YEAR END:"}


def metadata(html: str | None) -> dict[str, str | None]:
    """What follows the colon in the first element that holds each label."""
    root, out = parse(html), dict.fromkeys(LABELS)
    for e in [root, *root.walk()]:
        own = [c for c in e.children if isinstance(c, str)]
        for name, label in LABELS.items():
            if out[name] is None and any(label.lower() in s.lower() for s in own):
                value = "".join(e.texts()).partition(":")[2].strip()
                out[name] = value.zfill(10) if name == "cik" else value
    return out


# Words of a caption.
CAPTION_WORDS = (
    "consolidated statements", "consolidated balance", "balance sheet", "income statement", "cash flows", "shareholders equity",
    "statement of operations", "statement of financial position", "statement of cash flows", "statements of operations", "statements of comprehensive income",
)


def caption_of(e: Element) -> str | None:
    """A short heading; the bold parts of a block; a bold block; a block with caption words."""
    text = e.text()
    if re.fullmatch("h[1-6]", e.name):
        return text if 0 < len(text) < 200 else None
    if e.name not in ("div", "p"):
        return None
    bold = " ".join(b.text() for b in e.find_all("b", "strong"))
    if 0 < len(bold) < 200:
        return bold
    if not 0 < len(text) < 200:
        return None
    style = e.attrs.get("style", "").lower()
    heavy = "font-weight" in style and ("bold" in style or "700" in style)
    return text if heavy or any(w in text.lower() for w in CAPTION_WORDS) else None


def _caption_before(e: Element, most: int) -> str | None:
    for i, s in enumerate(e.before()):
        if i >= most:
            break
        if isinstance(s, Element) and (found := caption_of(s)):
            return found
    return None


def tables(html: str | None) -> list[tuple[str | None, list[list[str]]]]:
    """(caption, rows) of every table with rows; a cell repeats over the columns that it spans."""
    out = []
    for t in parse(html).find_all("table"):
        own = next(t.find_all("caption"), None)
        caption = own.text() if own is not None else _caption_before(t, 3) or (_caption_before(t.parent, 10) if t.parent is not None else None)
        rows = []
        for r in t.find_all("tr"):
            cells = []
            for c in r.find_all("td", "th"):
                span = c.attrs.get("colspan", "1").strip()
                cells += [c.text()] * (min(int(span[:9]), MOST_COLUMNS) if span.isdecimal() else 1)
            if cells:
                rows.append(cells)
        if rows:
            out.append((caption, rows))
    return out


def clean_column(df: DataFrame, html: str = "html", out: str = "text", parser: str = "clean") -> DataFrame:
    """Adds the cleaned text; parser is 'clean' or 'page_text'."""
    f = {"clean": clean, "page_text": page_text}[parser]

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(f)

    return df.withColumn(out, run(F.col(html)))


def metadata_column(df: DataFrame, html: str = "html", out: str = "metadata") -> DataFrame:
    @F.pandas_udf(", ".join(f"{n} string" for n in LABELS))
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metadata(h) for h in pages], columns=list(LABELS))

    return df.withColumn(out, run(F.col(html)))


def table_rows(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, position, caption, rows of every table of every page."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, i, c, r) for k, h in zip(pdf[key], pdf[html], strict=True) for i, (c, r) in enumerate(tables(h))]
            if found:
                yield pd.DataFrame(found, columns=[key, "position", "caption", "rows"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, position int, caption string, rows array<array<string>>")
