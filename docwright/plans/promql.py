"""A subset of PromQL as DataFrame plans.

Series are a long table (metric, labels map<string,string>, ts timestamp, value double), scraped at steps. An expression
is evaluated at instants ``at``, which are an array of timestamps; the answer is (at, labels, value).

The grammar: selectors with =, !=, =~, !~ matchers (regular expressions are anchored), ranges ``[5m]``, ``offset``, rate,
increase, avg_over_time, min_over_time, max_over_time, sum_over_time, count_over_time, histogram_quantile, abs, vector; the
aggregations sum, avg, min, max, count with by and without, before or after the argument; + - * / and comparisons between
vectors with equal labels or with numbers; ``or``; parentheses. rate is the reset-aware increase over the seconds of the
window; it does not extrapolate to the window's borders. Samples without a time or a value are no samples.

The borders of all windows cut time into segments. A sample meets its segment through a bucket of time, segments are
aggregated before they travel, and a window is put together from the few dyadic runs of segments that cover it, so that
overlapping windows copy no samples.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from docwright.operators.metrics import _quantile

TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:e[+-]?\d+)?)(?![a-zA-Z_0-9.])|(\"(?:[^\"\\]|\\.)*\")|([a-zA-Z_:][a-zA-Z0-9_:]*)|(\[\s*\d+[smhdw]\s*\])|(\d+[smhdw])|(=~|!~|!=|==|>=|<=|[-+*/(){},=<>]))")
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
#: Merges of a window's parts.
OVER_TIME = {
    "avg_over_time": lambda: F.sum("total") / F.sum("n"),
    "min_over_time": lambda: F.min("least"),
    "max_over_time": lambda: F.max("most"),
    "sum_over_time": lambda: F.sum("total"),
    "count_over_time": lambda: F.sum("n"),
}
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}
STALE = 300


class PromQLError(ValueError):
    pass


def seconds(text: str) -> int:
    n, unit = re.fullmatch(r"\[?\s*(\d+)([smhdw])\s*\]?", text).groups()
    return int(n) * UNITS[unit]


def dyadic(first: int, end: int):
    """(level, node) of the dyadic runs that make up the segments first to end - 1; node k of level l is the 2^l segments from k * 2^l on."""
    level = 0
    while first < end:
        if first & 1:
            yield level, first
            first += 1
        if end & 1:
            end -= 1
            yield level, end
        first, end, level = first >> 1, end >> 1, level + 1


@dataclass
class Number:
    value: float


@dataclass
class Selector:
    metric: str | None
    matchers: list
    window: int | None = None
    offset: int = 0


@dataclass
class Call:
    name: str
    args: list


@dataclass
class Aggregate:
    name: str
    arg: object
    labels: list
    without: bool


@dataclass
class Binary:
    op: str
    left: object
    right: object


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise PromQLError(f"unexpected {text[at:at + 10]!r} at {at}")
            kind = m.lastindex
            self.tokens.append((("number", "string", "name", "range", "duration", "sign")[kind - 1], m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, text = self.peek()
        if kind == "end" or (value is not None and text != value):
            raise PromQLError(f"expected {value or 'more'}, found {text or 'the end'}")
        self.at += 1
        return text

    def accept(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] != "string":
            self.at += 1
            return True
        return False

    LEVELS = (("or",), ("==", "!=", "<=", ">=", "<", ">"), ("+", "-"), ("*", "/"))

    def parse(self):
        out = self.level(0)
        if self.peek()[0] != "end":
            raise PromQLError(f"unexpected {self.peek()[1]!r}")
        return out

    def level(self, i: int):
        if i == len(self.LEVELS):
            return self.unary()
        left = self.level(i + 1)
        while self.peek()[1] in self.LEVELS[i] and self.peek()[0] in ("sign", "name"):
            op = self.take()
            left = Binary(op, left, self.level(i + 1))
        return left

    def unary(self):
        if self.accept("-"):
            return Binary("*", Number(-1.0), self.unary())
        if self.accept("("):
            out = self.level(0)
            self.take(")")
            return out
        kind, text = self.peek()
        if kind == "number":
            return Number(float(self.take()))
        if kind == "name" and text in AGGREGATES:
            return self.aggregate()
        if kind == "name" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "(":
            name = self.take()
            return Call(name, self.arguments())
        if kind == "name" or text == "{":
            return self.selector()
        raise PromQLError(f"unexpected {text or 'end'!r}")

    def arguments(self) -> list:
        self.take("(")
        out = []
        while not self.accept(")"):
            out.append(self.level(0))
            if not self.accept(","):
                self.take(")")
                break
        return out

    def grouping(self) -> tuple[list, bool] | None:
        for word in ("by", "without"):
            if self.accept(word):
                self.take("(")
                labels = []
                while not self.accept(")"):
                    labels.append(self.take())
                    self.accept(",")
                return labels, word == "without"
        return None

    def aggregate(self):
        name = self.take()
        group = self.grouping()
        args = self.arguments()
        group = group or self.grouping() or ([], False)
        return Aggregate(name, args[0], *group)

    def selector(self):
        s = Selector(None if self.peek()[1] == "{" else self.take(), [])
        if self.accept("{"):
            while not self.accept("}"):
                label, op = self.take(), self.take()
                if op not in ("=", "!=", "=~", "!~"):
                    raise PromQLError(f"unknown matcher {op}")
                s.matchers.append((label, op, self.take()[1:-1].replace('\\"', '"').replace("\\\\", "\\")))
                self.accept(",")
        if self.peek()[0] == "range":
            s.window = seconds(self.take())
        if self.accept("offset"):
            s.offset = seconds(self.take())
        return s


class Evaluator:
    """Plans an expression at instants. Every plan has (at, labels, value)."""

    def __init__(self, series: DataFrame, at: list[datetime]):
        self.series, self.spark = series, series.sparkSession
        self.instants = list(dict.fromkeys(at))
        self.at = self.spark.createDataFrame([(t,) for t in self.instants], "at timestamp")

    def matching(self, s: Selector) -> DataFrame:
        df = self.series if s.metric is None else self.series.filter(F.col("metric") == s.metric)
        for label, op, value in s.matchers:
            have = F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit(""))
            test = have.rlike(f"^(?:{value})$") if "~" in op else have == value
            df = df.filter(~test if op[0] == "!" else test)
        return df

    @staticmethod
    def keyed(df: DataFrame) -> DataFrame:
        """Labels as a sorted array, so that they can be grouped."""
        return df.withColumn("labels", F.array_sort(F.map_entries("labels")))

    def instant(self, s: Selector) -> DataFrame:
        """The newest sample of each series in the five minutes before the instant."""
        parts, wanted = self.parts(s, STALE)
        return self.merged(parts, wanted).agg(F.max_by("newest", "newest_at").alias("value"))

    def parts(self, s: Selector, width: int, deltas: bool = False) -> tuple[DataFrame, list]:
        """Samples' aggregates by (labels, segment), with their increases where ``deltas``, and the (at, level, node) that make up each window."""
        if width <= 0:
            raise PromQLError("an empty range")
        ends = [TimestampType().toInternal(t) - s.offset * 10**6 for t in self.instants]
        size = width * 10**6
        bounds = sorted({b for e in ends for b in (e - size, e)}) or [0, 1]
        place = {b: i for i, b in enumerate(bounds)}
        wanted = [(t, level, node) for t, e in zip(self.instants, ends, strict=True) for level, node in dyadic(place[e - size], place[e])]
        # Buckets as wide as the mean segment: at most two rows for each segment.
        low, step = bounds[0], -(-(bounds[-1] - bounds[0]) // (len(bounds) - 1))
        cuts = [(k, i, a, b) for i, (a, b) in enumerate(pairwise(bounds)) for k in range((a - low) // step, (b - 1 - low) // step + 1)]
        cuts = self.spark.createDataFrame(cuts, "bucket long, segment int, after long, upto long")
        inside = (F.col("ts") > F.timestamp_micros(F.lit(low))) & (F.col("ts") <= F.timestamp_micros(F.lit(bounds[-1])))
        samples = self.keyed(self.matching(s).filter(inside & F.col("value").isNotNull()))
        samples = samples.select("labels", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("bucket", F.expr(f"(us - {low} - 1) div {step}"))
        samples = samples.join(cuts, "bucket").filter((F.col("us") > F.col("after")) & (F.col("us") <= F.col("upto")))
        if deltas:
            # A fall is a reset: the counter began again at zero.
            before = F.lag("value").over(Window.partitionBy("labels", "segment").orderBy("us"))
            samples = samples.withColumn("d", self.delta(before, F.col("value")))
        else:
            samples = samples.withColumn("d", F.lit(0.0))
        return samples.groupBy("labels", "segment").agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("d").alias("inner"),
            F.min_by("value", "us").alias("oldest"), F.max_by("value", "us").alias("newest"), F.max("us").alias("newest_at"),
        ), wanted

    @staticmethod
    def delta(before: Column, value: Column) -> Column:
        return F.when(before.isNull(), 0.0).when(value < before, value).otherwise(value - before)

    def merged(self, parts: DataFrame, wanted: list):
        """Parts of dyadic runs, joined to the windows that they make up, grouped by (at, labels)."""
        deepest = max((level for _, level, _ in wanted), default=0)
        gap = F.col("gap") if "gap" in parts.columns else F.lit(0.0)
        runs = parts.withColumn("gap", gap).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumn("node", F.expr("shiftright(segment, level)"))
        runs = runs.groupBy("labels", "level", "node").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.max_by("newest", "newest_at").alias("newest"), F.max("newest_at").alias("newest_at"),
            F.sum("inner").alias("inner"), F.sum("gap").alias("gaps"), F.min_by("gap", "segment").alias("first_gap"), F.min("segment").alias("segment"),
        )
        return runs.join(self.spark.createDataFrame(wanted, "at timestamp, level int, node int"), ["level", "node"]).groupBy("at", "labels")

    def increase(self, s: Selector) -> DataFrame:
        """The increases inside a window's segments and between them; what leads to its first sample does not count."""
        parts, wanted = self.parts(s, s.window, deltas=True)
        before = F.lag("newest").over(Window.partitionBy("labels").orderBy("segment"))
        parts = parts.withColumn("gap", self.delta(before, F.col("oldest")))
        value = F.sum("inner") + (F.sum("gaps") - F.min_by("first_gap", "segment"))
        return self.merged(parts, wanted).agg(value.alias("value"), F.sum("n").alias("n")).filter("n > 1").drop("n")

    def plan(self, e) -> DataFrame | float:
        if isinstance(e, Number):
            return e.value
        if isinstance(e, Selector):
            if e.window is not None:
                raise PromQLError("a range needs a function")
            return self.instant(e)
        if isinstance(e, Call):
            return self.call(e)
        if isinstance(e, Aggregate):
            df = self.plan(e.arg)
            keep = F.filter("labels", lambda x: x["key"].isin(*e.labels) if e.labels else F.lit(False)) if not e.without else F.filter("labels", lambda x: ~x["key"].isin(*e.labels))
            return df.withColumn("labels", keep).groupBy("at", "labels").agg(AGGREGATES[e.name]("value").cast("double").alias("value"))
        return self.binary(e)

    def call(self, e: Call) -> DataFrame:
        if e.name in ("rate", "increase", *OVER_TIME):
            s = e.args[0]
            if not isinstance(s, Selector) or s.window is None:
                raise PromQLError(f"{e.name} needs a range")
            if e.name in OVER_TIME:
                return self.merged(*self.parts(s, s.window)).agg(OVER_TIME[e.name]().cast("double").alias("value"))
            df = self.increase(s)
            return df.withColumn("value", F.col("value") / s.window) if e.name == "rate" else df
        if e.name == "vector":
            return self.at.select("at", F.array().cast("array<struct<key:string,value:string>>").alias("labels"), F.lit(e.args[0].value).alias("value"))
        if e.name == "abs":
            return self.plan(e.args[0]).withColumn("value", F.abs("value"))
        if e.name == "histogram_quantile":
            df = self.plan(e.args[1])
            le = F.get(F.filter("labels", lambda x: x["key"] == "le"), F.lit(0))["value"]
            bound = F.when(le == "+Inf", float("inf")).otherwise(le.try_cast("double"))
            rest = F.filter("labels", lambda x: x["key"] != "le")
            h = df.select("at", rest.alias("labels"), F.struct(bound.alias("le"), F.col("value").alias("n")).alias("b")).groupBy("at", "labels").agg(F.array_sort(F.collect_list("b")).alias("h"))
            return h.select("at", "labels", _quantile(e.args[0].value, F.col("h")).alias("value")).filter("value is not null")
        raise PromQLError(f"unknown function {e.name}")

    def binary(self, e: Binary) -> DataFrame | float:
        left, right = self.plan(e.left), self.plan(e.right)
        if e.op == "or":
            return left.unionByName(right.join(left.select("at", "labels"), ["at", "labels"], "left_anti"))
        if isinstance(left, float) and isinstance(right, float):
            if e.op in COMPARE:
                raise PromQLError("two numbers are not compared")
            return {"+": left + right, "-": left - right, "*": left * right, "/": left / right if right else float("nan")}[e.op]
        both = self.matched(left, right)
        if e.op in COMPARE:
            return both.filter(COMPARE[e.op](F.col("l"), F.col("r"))).select("at", "labels", F.col("r" if isinstance(left, float) else "l").alias("value"))
        return both.select("at", "labels", ARITHMETIC[e.op](F.col("l"), F.col("r")).alias("value")).filter("value is not null")

    @staticmethod
    def matched(left, right) -> DataFrame:
        if isinstance(left, float):
            return right.select("at", "labels", F.lit(left).alias("l"), F.col("value").alias("r"))
        if isinstance(right, float):
            return left.select("at", "labels", F.col("value").alias("l"), F.lit(right).alias("r"))
        return left.withColumnRenamed("value", "l").join(right.withColumnRenamed("value", "r"), ["at", "labels"])


def evaluate(expression: str, series: DataFrame, at: list[datetime]) -> DataFrame:
    """(at, labels, value) of a PromQL expression at the instants; labels are a map."""
    out = Evaluator(series, at).plan(Parser(expression).parse())
    if isinstance(out, float):
        spark: SparkSession = series.sparkSession
        return spark.createDataFrame([(t, {}, out) for t in at], "at timestamp, labels map<string,string>, value double")
    return out.select("at", F.map_from_entries("labels").alias("labels"), "value")


def label(name: str) -> Column:
    return F.try_element_at("labels", F.lit(name))
