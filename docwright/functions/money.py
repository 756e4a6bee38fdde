"""Growth, margins, fiscal calendars and the text forms of values and periods, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,10)"


def growth(current: Column, prior: Column) -> Column:
    """Signed-denominator growth; null where the prior value is null or zero."""
    return F.try_divide(current - prior, prior)


def growth_abs(current: Column, prior: Column) -> Column:
    """Growth over the absolute prior value, half-even to 4 places."""
    c, p = current.cast("decimal(18,4)"), prior.cast("decimal(18,4)")
    return F.bround(F.try_divide(c - p, F.abs(p)), 4)


def margin(part: Column, whole: Column) -> Column:
    """part / whole, half-even to 4 places; null for a zero whole."""
    return F.bround(F.try_divide(part.cast("decimal(18,4)"), whole.cast("decimal(18,4)")), 4)


def year_of_two_digits(y: Column) -> Column:
    """Two digits up to 50 are of this century, above of the last; other years stay."""
    return F.when(y >= 100, y).when(y <= 50, y + 2000).otherwise(y + 1900)


def fiscal_quarter(year: Column, quarter: Column, end_month: int = 12) -> Column:
    """struct(start, end) of a fiscal quarter when the fiscal year ends in end_month."""
    first = F.make_date(year, F.lit(end_month), F.lit(1))
    start = F.add_months(first, (quarter * 3 - 14).cast("int"))
    return F.struct(start.alias("start"), F.last_day(F.add_months(start, 2)).alias("end"))


def fiscal_year(year: Column, end_month: int = 12) -> Column:
    """struct(start, end) of a fiscal year."""
    start = F.add_months(F.make_date(year, F.lit(end_month), F.lit(1)), -11)
    return F.struct(start.alias("start"), F.last_day(F.make_date(year, F.lit(end_month), F.lit(1))).alias("end"))


def fiscal_half(year: Column, half: Column, end_month: int = 12) -> Column:
    """struct(start, end) of a fiscal half: six months, whatever the year's end."""
    start = F.add_months(F.make_date(year, F.lit(end_month), F.lit(1)), (half * 6 - 17).cast("int"))
    return F.struct(start.alias("start"), F.last_day(F.add_months(start, 5)).alias("end"))


def calendar_quarter(start: Column) -> Column:
    """struct(year, quarter, start, end) of the calendar quarter that holds the first day of a fiscal one."""
    first = F.trunc(start, "quarter")
    return F.struct(F.year(start).alias("year"), F.quarter(start).alias("quarter"), first.alias("start"), F.last_day(F.add_months(first, 2)).alias("end"))


def period_of_date(text: Column) -> Column:
    """struct(year, quarter) of an ISO date; null fields if it is none."""
    d = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    return F.struct(F.year(d).alias("year"), F.quarter(d).alias("quarter"))


# Scale words, symbols and stripped characters.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
NOT_NUMBER = r"[$€£¥,()\s—–-]"
NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^(nan|inf(inity)?)$"


def scale_of(context: Column) -> Column:
    """billions, millions or thousands, as 'in <scale>' says; else null."""
    c = F.lower(context)
    return F.when(F.contains(c, F.lit("in billions")), "billions").when(F.contains(c, F.lit("in millions")), "millions").when(F.contains(c, F.lit("in thousands")), "thousands")


def scale_multiplier(scale: Column) -> Column:
    return F.when(scale == "billions", 1e9).when(scale == "millions", 1e6).when(scale == "thousands", 1e3).otherwise(1.0)


def cell_value(cell: Column, context: Column, strict_reference: bool = False) -> Column:
    """struct(value_type, value, currency, scale, is_negative) of a table cell.

    Blank cells are text. A cell with % is a percentage. What is a number once symbols and signs are gone is currency (with
    a symbol), shares (the context speaks of shares and there is no point) or integer; without a symbol the currency is USD.
    Negative by a parenthesis, or by a leading minus or dash, also behind the symbol ("$-5"; with strict_reference its sign is
    lost). Values have up to 28 digits before the point and 10 behind it.
    """
    t = F.trim(F.coalesce(cell, F.lit("")))
    bare = F.regexp_replace(t, NOT_NUMBER, "")
    percent = F.contains(t, F.lit("%"))
    is_number = (t != "") & ~percent & bare.rlike(NUMBER)
    negative = F.when(percent, F.contains(t, F.lit("(")) | F.contains(t, F.lit("-"))).otherwise(F.contains(t, F.lit("(")) | t.rlike("^[-—]" if strict_reference else r"^[$€£¥]?\s*[-—]"))
    share = F.contains(F.lower(F.coalesce(context, F.lit(""))), F.lit("share")) & ~F.contains(t, F.lit("."))
    symbol = F.lit(None).cast("string")
    for s, name in reversed(SYMBOLS.items()):
        symbol = F.when(F.contains(t, F.lit(s)), name).otherwise(symbol)
    first = F.nullif(F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    size = F.when(percent, first.try_cast(WIDE)).when(is_number, F.abs(bare.try_cast(WIDE)))
    kind = F.when(percent & first.isNotNull(), "percentage").when(is_number & share, "shares").when(is_number & symbol.isNotNull(), "currency").when(is_number, "integer").otherwise("text")
    return F.struct(
        kind.alias("value_type"),
        F.when(kind != "text", F.when(negative, -size).otherwise(size)).alias("value"),
        F.when(kind.isin("currency", "integer"), F.coalesce(symbol, F.lit("USD"))).alias("currency"),
        F.when(kind.isin("currency", "integer", "shares"), scale_of(context)).alias("scale"),
        F.coalesce(F.when(kind != "text", negative), F.lit(False)).alias("is_negative"),
    )


def parse_table(rows: Column, caption: Column, strict_reference: bool = False) -> Column:
    """cell_value of every cell of rows (arrays of arrays), with the caption as context."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: cell_value(c, caption, strict_reference)))


def unit_of(text: Column) -> Column:
    """thousands, billions, else millions."""
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("thousand")), "thousands").when(F.contains(t, F.lit("billion")), "billions").otherwise("millions")


def in_millions(text: Column, unit: Column, whole_digits: bool = True) -> Column:
    """First number of a text in millions; negative in parentheses. With whole_digits false an ungrouped number is cut to three digits."""
    pattern = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)" if whole_digits else r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"
    n = F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), ",", "").try_cast("decimal(24,6)")
    u = F.lower(unit)
    n = n * F.when(u.startswith("thousand"), F.lit("0.001").cast("decimal(8,3)")).when(u.startswith("billion"), F.lit("1000").cast("decimal(8,3)")).otherwise(F.lit("1").cast("decimal(8,3)"))
    return F.when(F.trim(text).isin("", "—", "-"), None).otherwise(F.when(F.contains(text, F.lit("(")) & F.contains(text, F.lit(")")), -n).otherwise(n))


# Names of months and quarters.
MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
MONTHS |= {m[:3]: i for m, i in list(MONTHS.items())} | {"sept": 9}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4}


def _named(names: dict[str, int], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(c))


def reported_period(text: Column) -> Column:
    """struct(fiscal_year, fiscal_quarter, label) of a column heading.

    'three months' with a quarter's last month gives the quarter, 'year ended' or 'twelve months' the year.
    """
    t = F.lower(text)
    year = F.regexp_extract(t, r"(20\d{2})", 1).try_cast("int")
    month = F.lit(None).cast("int")
    for i, m in ((4, "december"), (3, "september"), (2, "june"), (1, "march")):
        month = F.when(F.contains(t, F.lit(m)), i).otherwise(month)
    quarter = F.when(F.contains(t, F.lit("three months")), month)
    annual = F.contains(t, F.lit("year ended")) | F.contains(t, F.lit("twelve months"))
    label = F.when(year.isNull(), None).when(quarter.isNotNull(), F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string"))).when(annual, F.concat(F.lit("FY "), year.cast("string")))
    return F.struct(year.alias("fiscal_year"), quarter.alias("fiscal_quarter"), label.alias("label"))


# How periods are written. Kind, pattern, year group, number group, names of the number.
PERIODS = (
    ("quarterly", r"(?i)\b(q)([1-4])[,\s\-']*(\d{2,4})\b", 3, 2, None),
    ("quarterly", r"(?i)\b([1-4])(q)[,\s\-']*(\d{2,4})\b", 3, 1, None),
    ("quarterly", r"(?i)\b(First|Second|Third|Fourth)\s+Quarter\s+(\d{4})\b", 2, 1, ORDINALS),
    ("quarterly", r"(?i)\bThree\s+Months\s+Ended\s+([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b", 3, 1, {m: (i + 2) // 3 for m, i in MONTHS.items()}),
    ("annual", r"(?i)\bfy[,\s\-']*(\d{2,4})\b", 1, None, None),
    ("annual", r"(?i)\bfiscal\s+year\s+(\d{4})\b", 1, None, None),
    ("annual", r"(?i)\byear\s+ended\s+([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b", 3, None, None),
    ("annual", r"(?i)\b12\s+months?\s+ended\s+([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b", 3, None, None),
    ("semi_annual", r"(?i)\b(h)([1-2])[,\s\-']*(\d{2,4})\b", 3, 2, None),
    ("semi_annual", r"(?i)\b(First|Second)\s+Half\s+(\d{4})\b", 2, 1, ORDINALS),
    ("semi_annual", r"(?i)\bSix\s+Months?\s+Ended\s+([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b", 3, 1, {m: 1 if i <= 6 else 2 for m, i in MONTHS.items()}),
)


def _period(kind: str, pattern: str, year_at: int, number_at: int | None, names: dict | None, end_month: int):
    """A function from a match to its period."""

    def one(m: Column) -> Column:
        year = year_of_two_digits(F.regexp_extract(m, pattern, year_at).try_cast("int"))
        part = F.regexp_extract(m, pattern, number_at) if number_at else None
        number = F.lit(None).cast("int") if part is None else _named(names, part) if names else part.try_cast("int")
        if kind == "annual":
            dates, label = fiscal_year(year, end_month), F.concat(F.lit("FY "), year.cast("string"))
        else:
            dates = (fiscal_quarter if kind == "quarterly" else fiscal_half)(year, number, end_month)
            label = F.concat(F.lit("Q" if kind == "quarterly" else "H"), number.cast("string"), F.lit(" "), year.cast("string"))
        return F.struct(F.lit(kind).alias("period_type"), year.alias("year"), number.alias("number"), label.alias("label"), dates["start"].alias("start"), dates["end"].alias("end"))

    return one


def periods_in(text: Column, end_month: int = 12) -> Column:
    """Array of struct(period_type, year, number, label, start, end) of the periods that a text names, each once."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p[1]), F.lit(0)), _period(*p, end_month)) for p in PERIODS]
    return F.array_distinct(F.filter(F.concat(*found), lambda p: p["start"].isNotNull() & p["end"].isNotNull()))


# How amounts and shares are written in prose.
MONEY = r"(?i)[$€£¥]\s*[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|trillion|thousand|M|B|T|K)\b)?"
PERCENT = r"\d+(?:\.\d+)?\s*%"
MONEY_AS_WRITTEN = r"(?i)[$€£¥]\s*[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|trillion|M|B|T|K|thousand))?"


def money_in(text: Column, strict_reference: bool = False) -> Column:
    """Array of the amounts in a text. strict_reference takes a unit letter off a following word, as in '$5 to'."""
    return F.regexp_extract_all(text, F.lit(MONEY_AS_WRITTEN if strict_reference else MONEY), F.lit(0))


def money_value(money: Column) -> Column:
    """The amount in single units as a double; null if it has no number."""
    t = F.lower(F.trim(F.regexp_replace(money, "[$€£¥,]", "")))
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.regexp_extract(t, r"([a-z]+)$", 1)
    return n * F.when(unit.isin("trillion", "t"), 1e12).when(unit.isin("billion", "b"), 1e9).when(unit.isin("million", "m"), 1e6).when(unit.isin("thousand", "k"), 1e3).otherwise(1.0)


def percents_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PERCENT), F.lit(0))


def percent_value(percent: Column) -> Column:
    return F.trim(F.regexp_replace(percent, "%", "")).try_cast("double")
