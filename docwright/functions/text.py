"""Text cleaning, statistics, windows, hashes and guards, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is replaced, dropped and looked for.
REPLACEMENTS = ((" ", " "), ("​", ""), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."))
BOILERPLATE = (
    r"Table of Contents", r"Return to Index", r"Back to Table of Contents", r"^\s*\d+\s*$",
    r"UNITED STATES\s+SECURITIES AND EXCHANGE COMMISSION", r"Washington,?\s+D\.?C\.?\s+\d{5}", r"Commission File Number:?\s*\d+-\d+",
)
KEYWORDS = (
    "revenue", "net income", "operating income", "gross profit", "cash flow", "total assets", "total liabilities", "earnings per share",
    "investment", "capital expenditure", "acquisition", "growth", "margin", "profit", "loss", "dividend", "stock", "share",
    "artificial intelligence", "ai", "machine learning", "cloud", "strategy", "outlook", "guidance", "forecast", "expect",
)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: what a lambda refers to from outside is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# F.trim takes the characters to cut as a second argument: handed to F.transform by itself, it is given the position of the element.


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_characters(text: Column) -> Column:
    """Typographic characters as plain ones; the compatibility form is a parser's step (see sources.html)."""
    for old, new in REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def drop_boilerplate(text: Column) -> Column:
    """Without the lines that hold boilerplate and those of fewer than three characters."""
    pattern = "(?i)" + "|".join(BOILERPLATE)
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.rlike(pattern) & (F.length(F.trim(s)) >= 3)), "\n")


def normalize_whitespace(text: Column) -> Column:
    """Runs of blanks to one, tabs to blanks, three and more line breaks to two, lines trimmed; in this order."""
    t = F.regexp_replace(F.replace(F.regexp_replace(text, " {2,}", " "), F.lit("\t"), F.lit(" ")), "\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(t, "\n"), lambda s: F.trim(s)), "\n")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_tags(html: Column) -> Column:
    """Tags to blanks, then one line."""
    return one_line(F.regexp_replace(html, "<[^>]+>", " "))


def strip_markup(html: Column, hidden: tuple[str, ...] = ("script", "style")) -> Column:
    """Without comments, the content of hidden elements, and tags; entities of text decoded."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for name in hidden:
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return one_line(t)


def strip_filing_marks(text: Column, urls: bool = False) -> Column:
    """Without taxonomy names and time stamps, and without addresses if asked."""
    names = "[A-Za-z0-9]+" if urls else "[A-Za-z]+"
    for p in (f"us-gaap:{names}", f"dei:{names}", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", *([r"https?://\S+"] if urls else [])):
        text = F.regexp_replace(text, p, "")
    return F.trim(text)


def phrases(text: Column) -> Column:
    """Lines and phrases (split at double blanks), trimmed, one a line, without empty ones."""
    parts = F.flatten(F.transform(F.split(text, "\n"), lambda s: F.split(F.trim(s), "  ")))
    return F.array_join(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != ""), "\n")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def stats(text: Column) -> Column:
    """struct(chars, words, lines, paragraphs)."""
    paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != ""))
    return F.struct(F.length(text).alias("chars"), F.size(words(text)).alias("words"), F.size(F.split(text, "\n")).alias("lines"), paragraphs.alias("paragraphs"))


def word_windows(text: Column, size: int, stride: int, least: int = 1) -> Column:
    """Array of struct(i, text, n) of windows that begin every ``stride`` words and have at least ``least``."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        made = F.transform(starts, lambda s: F.struct((s / stride).cast("int").alias("i"), F.array_join(F.slice(w, s + 1, size), " ").alias("text"), F.least(F.lit(size), F.size(w) - s).alias("n")))
        return F.filter(made, lambda c: c["n"] >= least)

    return let(words(text), of)


def word_windows_to_end(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """Array of struct(i, text, n): windows that overlap and stop with the one that reaches the end."""

    def of(w: Column) -> Column:
        k = F.greatest(F.lit(1), F.ceil((F.size(w) - overlap) / (size - overlap)).cast("int"))
        at = F.when(F.size(w) > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("i"), F.array_join(F.slice(w, i * (size - overlap) + 1, size), " ").alias("text"), F.least(F.lit(size), F.size(w) - i * (size - overlap)).alias("n")))

    return let(words(text), of)


#: Characters and overlap of a chunk.
PRESETS = {"default": (512, 50), "small": (256, 25), "large": (1024, 100), "semantic": (512, 50)}


def char_windows(text: Column, preset: str = "default") -> Column:
    """Array of struct(i, start, end, text): character windows; blank ones are left out, none begins within the overlap of the end.

    The text is cut once into blocks as long as the stride; a window is a block and the beginning of the next, so the work
    is linear in the length of a text.
    """
    size, overlap = PRESETS[preset]
    stride = size - overlap

    def of(blocks: Column) -> Column:
        n = (F.size(blocks) - 1) * stride + F.length(F.try_element_at(blocks, F.lit(-1)))
        k = F.greatest(F.lit(1), F.ceil((n - overlap) / stride).cast("int"))
        at = F.when(F.size(blocks) > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        cut = lambda i: F.concat(F.get(blocks, i), F.left(F.coalesce(F.get(blocks, i + 1), F.lit("")), F.lit(overlap)))
        made = F.transform(at, lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + size, n).alias("end"), cut(i).alias("text")))
        full = F.filter(made, lambda c: F.trim(F.regexp_replace(c["text"], r"\s+", " ")) != "")
        return F.transform(full, lambda c, i: F.struct(i.alias("i"), c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text")))

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{stride}}}"), F.lit(0)), of)


def recommended_preset(fragmentation: Column, average: Column, coherence: Column, target: Column) -> Column:
    found = F.when(F.coalesce(fragmentation, F.lit(0.0)) > 0.7, "large").when(F.coalesce(average, F.lit(512.0)) > 800, "small").when(F.coalesce(coherence, F.lit(1.0)) < 0.6, "semantic").otherwise("default")
    return F.coalesce(target, found)


def keyword_sentences(text: Column, header: Column, most: int = 200) -> Column:
    """Header and the sentences of 51 to 999 characters with a keyword, at most ``most``; without any, the first 30000 characters."""
    # A sentence is tried against one alternation, inside generated code.
    pattern = "|".join(KEYWORDS)
    found = F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: (F.length(s) > 50) & (F.length(s) < 1000) & F.lower(s).rlike(pattern))
    chosen = lambda f: F.transform(F.slice(f, 1, most), lambda s: F.concat(s, F.lit(".")))
    return F.concat(header, let(found, lambda f: F.when(F.size(f) > 0, F.array_join(chosen(f), " ")).otherwise(F.substring(text, 1, 30000))))


def content_hash(text: Column, algorithm: str = "sha256") -> Column:
    """Hex digest; empty content and unknown algorithms are errors."""
    if algorithm not in ("sha256", "md5", "sha1"):
        raise ValueError(f"unknown algorithm: {algorithm}")
    digest = F.sha2(text, 256) if algorithm == "sha256" else F.md5(text) if algorithm == "md5" else F.sha1(text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("content is empty")).cast("string")).otherwise(digest)


def cache_key(question: Column, tenant: Column | None = None) -> Column:
    q = F.lower(F.trim(question))
    return F.substring(F.sha2(q if tenant is None else F.concat(tenant, F.lit(":"), q), 256), 1, 32)


def span(document: Column, chunk: Column) -> Column:
    """struct(start, end, first_line, last_line) of the first place of a chunk: half-open characters, lines from 1; null if absent."""
    start = F.instr(document, chunk) - 1
    breaks = lambda s: F.length(F.regexp_replace(s, "[^\n]", ""))
    first = breaks(F.substring(document, F.lit(1), start)) + 1
    return F.when(start >= 0, F.struct(start.alias("start"), (start + F.length(chunk)).alias("end"), first.alias("first_line"), (first + breaks(chunk)).alias("last_line")))


def verify_hash(text: Column, digest: Column) -> Column:
    """struct(valid, message)."""
    same = F.sha2(text, 256) == digest
    return F.struct(same.alias("valid"), F.when(same, "hash verified").otherwise("hash mismatch").alias("message"))


# Fixed values of the guards.
JAILBREAK = ("ignore previous instructions", "forget all previous", "you are now", "disregard all prior", "act as if", "pretend you are")
EMAIL, PHONE, SSN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\d{3}-\d{2}-\d{4}\b"
OFFENSIVE = ("hate", "violence", "offensive")
FALLBACK = {
    "input_validation": "I'm sorry, but I couldn't process your request. Please rephrase your question.",
    "jailbreak_detector": "I'm sorry, but I can only help with financial document questions. Please ask about SEC filings or financial data.",
    "output_moderator": "I'm sorry, but I couldn't generate an appropriate response. Please try a different question.",
    "citation_verifier": "I'm sorry, but I couldn't verify the sources for this response. Please try again.",
    "policy_engine": "I'm sorry, but this request violates our usage policy. Please review our terms of service.",
}


def _first_of(text: Column, terms: tuple[str, ...]) -> Column:
    t, out = F.lower(text), F.lit(None).cast("string")
    for w in reversed(terms):
        out = F.when(F.contains(t, F.lit(w)), w).otherwise(out)
    return out


def guard_question(text: Column) -> Column:
    """struct(passed, blocked_by, pattern): length first, then jailbreak phrases."""
    hit, long = _first_of(text, JAILBREAK), F.length(text) > 500
    by = F.when(long, "input_validation").when(hit.isNotNull(), "jailbreak_detector")
    return F.struct(by.isNull().alias("passed"), by.alias("blocked_by"), F.when(~long, hit).alias("pattern"))


def redact(text: Column) -> Column:
    """struct(text, kinds): e-mail addresses, then phone numbers, then social security numbers."""
    out, kinds = text, []
    # A character that every match needs is looked for first: most texts have no address.
    for kind, pattern, needs in (("email", EMAIL, F.contains(text, F.lit("@"))), ("phone", PHONE, None), ("ssn", SSN, None)):
        hit = out.rlike(pattern) if needs is None else needs & out.rlike(pattern)
        kinds.append(F.when(hit, kind))
        replaced = F.regexp_replace(out, pattern, f"[{kind.upper()}_REDACTED]")
        out = replaced if needs is None else F.when(needs, replaced).otherwise(out)
    return F.struct(out.alias("text"), F.array_compact(F.array(*kinds)).alias("kinds"))


def moderate(text: Column) -> Column:
    """The first offensive term that occurs, as a part of words too; null if none."""
    return _first_of(text, OFFENSIVE)


def citations_verified(citations: Column) -> Column:
    """Whether every citation (struct with sha256) has a hash; true without any."""
    return F.coalesce(F.forall(citations, lambda c: F.coalesce(c["sha256"], F.lit("")) != ""), F.lit(True))


def fallback(blocked_by: Column) -> Column:
    out = F.lit("I'm sorry, but I couldn't complete your request.")
    for by, message in FALLBACK.items():
        out = F.when(blocked_by == by, message).otherwise(out)
    return F.concat(out, F.lit("\n\nFor assistance, visit our help documentation."))


def route_model(question: Column) -> Column:
    """struct(model, reason)."""
    q = F.lower(question)
    calc = q.rlike("calculate|compare|change|growth")
    hard = (F.size(words(question)) > 20) | F.contains(q, F.lit("complex"))
    return F.struct(F.when(calc | hard, "gpt-4-turbo").otherwise("gpt-3.5-turbo").alias("model"), F.when(calc, "calculation_required").when(hard, "complex_query").otherwise("simple_query").alias("reason"))


def context(chunks: Column, most: int = 5, chars: int = 800) -> Column:
    """Numbered context of the first chunks, each cut."""
    return F.array_join(F.transform(F.slice(chunks, 1, most), lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(c, 1, chars))), "\n\n")


def tenant(claim: Column, groups: Column) -> Column:
    """struct(tenant, roles): a claim, else the first tenant_ group, else default; other groups are roles."""
    marked = F.filter(groups, lambda g: g.startswith("tenant_"))
    named = F.transform(marked, lambda g: F.substring(g, F.lit(8), F.length(g)))
    return F.struct(F.coalesce(F.nullif(claim, F.lit("")), F.get(named, F.lit(0)), F.lit("default")).alias("tenant"), F.filter(groups, lambda g: ~g.startswith("tenant_")).alias("roles"))


# Entity patterns.
HEALTHCARE = {
    "DIAGNOSIS": r"\b(?:diagnosis|diagnosed with|condition|disease|disorder|syndrome)\b",
    "PROCEDURE": r"\b(?:surgery|procedure|treatment|therapy|intervention)\b",
    "MEDICATION": r"\b(?:medication|drug|prescription|dosage|pharmaceutical)\b",
    "DEPARTMENT": r"\b(?:Emergency|ER|ICU|NICU|PICU|CCU|OR|PACU|L&D|Med-Surg|Oncology|Cardiology|Orthopedics|Pediatrics|Radiology|Pharmacy|Lab)\b",
    "STAFF_ROLE": r"\b(?:physician|nurse|RN|LPN|NP|PA|technician|therapist|aide|administrator)\b",
    "FACILITY_TYPE": r"\b(?:hospital|clinic|medical center|health system|urgent care|ambulatory|outpatient|inpatient)\b",
    "QUALITY_METRIC": r"\b(?:readmission rate|mortality rate|infection rate|patient satisfaction|HCAHPS|Core Measures|quality score)\b",
    "COMPLIANCE_STANDARD": r"\b(?:HIPAA|CMS|Joint Commission|OSHA|FDA|state regulations|accreditation|certification)\b",
    "RATE_VALUE": r"\b\d+(?:\.\d+)?%\b",
    "TIME_VALUE": r"\b\d+(?:\.\d+)?\s*(?:minutes?|hours?|days?|weeks?|months?)\b",
    "COUNT_VALUE": r"\b\d{1,3}(?:,\d{3})*\s*(?:patients?|visits?|admissions?|discharges?|beds?)\b",
}
FINANCE = {
    "COMPANY": r"\b(?:Inc\.|Corp\.|Corporation|LLC|Ltd\.|Company)\b",
    "TICKER": r"\b[A-Z]{1,5}\b",
    "CURRENCY": r"\$\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|M|B))?\b",
    "PERCENTAGE": r"\b\d+(?:\.\d+)?%\b",
    "FISCAL_PERIOD": r"\b(?:Q[1-4]|FY|fiscal year|quarter)\s*\d{2,4}\b",
    "FILING_TYPE": r"\b(?:10-K|10-Q|8-K|S-1|DEF 14A)\b",
}


def entities(text: Column, patterns: dict[str, str]) -> Column:
    """Map from entity type to its sorted distinct mentions, for the types that occur; case does not count."""
    made = [F.struct(F.lit(k).alias("key"), F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)), lambda m: F.trim(m)))).alias("value")) for k, p in patterns.items()]
    return F.map_from_entries(F.filter(F.array(*made), lambda e: F.size(e["value"]) > 0))
