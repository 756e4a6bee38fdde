"""Sources and sinks: submission records, object keys, JSON lines, event streams of answers, synthetic filings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docwright.operators import relational as R

EVAL_QUERY = T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("expected_doc_ids", T.ArrayType(T.StringType())), T.StructField("category", T.StringType())])
FILING = "cik string, company_name string, form_type string, filing_date string, accession_number string, primary_document string"


def json_lines(spark: SparkSession, path: str, schema: T.StructType = EVAL_QUERY, fallback: DataFrame | None = None) -> DataFrame:
    """Records of a JSON-lines file, blank lines skipped, unparsable ones an error; ``fallback`` if the file is absent."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fallback is not None and not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return fallback
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def submissions(records: DataFrame, forms: Sequence[str] | None = None, start: str | None = None, end: str | None = None, most: int | None = None) -> DataFrame:
    """Filings from submission records (cik, name, recent: struct of parallel arrays): by form and by ISO date, at most ``most`` for a cik, in the order given."""
    arrays = [F.col(f"recent.{c}").alias(c) for c in ("accessionNumber", "filingDate", "form", "primaryDocument")]
    z = records.select(R.zero_fill(F.col("cik")).alias("cik"), F.col("name").alias("company_name"), F.posexplode(F.arrays_zip(*arrays)).alias("seq", "z"))
    f = z.select("cik", "company_name", F.col("z.form").alias("form_type"), F.col("z.filingDate").alias("filing_date"), F.col("z.accessionNumber").alias("accession_number"), F.col("z.primaryDocument").alias("primary_document"), "seq")
    if forms:
        f = f.filter(F.col("form_type").isin(*forms))
    if start:
        f = f.filter(F.col("filing_date") >= start)
    if end:
        f = f.filter(F.col("filing_date") <= end)
    return (R.first_per_key(f, ["cik"], [F.col("seq")], most) if most else f).drop("seq")


def documents_written(df: DataFrame, path: str, by: Sequence[str] = ("cik", "form_type")) -> None:
    """Writes records partitioned by key and form; the key loses its leading zeros. Partitions are replaced, so a rerun gives the same tree."""
    out = df.withColumn("cik", F.regexp_replace("cik", "^0+", "")) if "cik" in df.columns else df
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def objects(spark: SparkSession, path: str, text: bool = True) -> DataFrame:
    """Stored objects: path and content, as text or with the bytes, length and time of change."""
    if text:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return spark.read.format("binaryFile").load(path)


def recent_objects(files: DataFrame, anchor: Column, days: int = 7) -> DataFrame:
    """Listing (path, modificationTime) of the last days, the path cut into cik, ticker and kind."""
    p = F.split("path", "/")
    return files.filter(F.col("modificationTime") >= anchor - F.make_interval(days=F.lit(days))).select("path", F.try_element_at(p, F.lit(-3)).alias("cik"), F.try_element_at(p, F.lit(-2)).alias("ticker"), F.regexp_replace(F.try_element_at(p, F.lit(-1)), r"\.[^.]*$", "").alias("kind"))


def json_or_text(raw: Column, field: str = "text") -> Column:
    """The field of a JSON record, or the raw text if it is none."""
    return F.coalesce(F.get_json_object(raw, f"$.{field}"), raw)


def replace_documents(df: DataFrame, path: str, key: str = "document_id", buckets: int = 256) -> None:
    """Delete-then-insert: all rows of the documents in df are replaced, other documents stay.

    Documents lie in ``buckets`` folders by a hash of their key. Only folders that df touches are rewritten, with the rows of
    their other documents; the number of folders does not grow with that of documents.
    """
    spark, column = df.sparkSession, "_bucket"
    new = df.withColumn(column, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        touched = [r[0] for r in new.select(column).distinct().collect()]  # at most `buckets`
        old = spark.read.parquet(path).filter(F.col(column).isin(touched))
        new = new.unionByName(old.join(df.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def export_records(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One JSON object a record, in folders by the columns ``by``."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def export_summary(df: DataFrame, key: str, period: str) -> DataFrame:
    """key, n_periods, latest, periods: a summary object for each key, periods newest first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_periods"), F.max(period).alias("latest"), F.reverse(F.array_sort(F.collect_set(period))).alias("periods"))


def dimension(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """A mapping with the overrides' rows in place of the defaults'."""
    return overrides.unionByName(defaults.join(overrides.select(key), key, "left_anti"))


def tracking_runs(runs: DataFrame, most: int) -> DataFrame:
    """run_id, start_time, metrics, params of the newest runs; key and value arrays become maps, later keys win."""
    as_map = lambda c: F.aggregate(c, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["key"]), F.create_map(x["key"], x["value"].cast("string"))))
    return runs.orderBy(F.desc("info.start_time"), "info.run_id").limit(most).select("info.run_id", "info.start_time", as_map("data.metrics").alias("metrics"), as_map("data.params").alias("params"))


def metric_by_class(metrics: Column, name: str) -> Column:
    """Value of the last metric whose key holds the name."""
    hits = F.filter(F.map_entries(metrics), lambda e: F.contains(F.lower(e["key"]), F.lit(name)))
    return F.try_element_at(hits, F.lit(-1))["value"].try_cast("double")


def answer_events(lines: DataFrame, request: str = "request_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """request_id, answer, n_tokens, citations, done, error from lines ``data: {json}`` of token, citation, done and error events."""
    data = lines.filter(F.col(line).startswith("data: ")).withColumn("j", F.substr(F.col(line), F.lit(7)))
    field = lambda f: F.get_json_object("j", f"$.{f}")
    e = data.select(request, F.struct(F.col(seq).alias("seq"), field("type").alias("type"), F.coalesce(field("content"), field("data")).alias("content")).alias("e"))
    ordered = F.array_sort(F.collect_list("e"))
    g = e.groupBy(request).agg(ordered.alias("e"))
    of = lambda kind: F.transform(F.filter("e", lambda x: x["type"] == kind), lambda x: F.coalesce(x["content"], F.lit("")))
    return g.select(request, F.array_join(of("token"), "").alias("answer"), F.size(of("token")).alias("n_tokens"), of("citation").alias("citations"), (F.size(of("done")) > 0).alias("done"), F.get(of("error"), F.lit(0)).alias("error"))


def synthetic_filings(spark: SparkSession, companies: Sequence[tuple[str, str]], years: Sequence[int], sections: Sequence[str] = ("Business", "Risk Factors", "Discussion")) -> DataFrame:
    """Filings from templates: one for each company (ticker, name) and year, with a text for every section."""
    c = spark.createDataFrame(list(companies), "ticker string, company_name string")
    y = spark.createDataFrame([(v,) for v in years], "fiscal_year int")
    text = F.concat_ws("\n", *[F.format_string(f"# {s}\n%s reports on {s.lower()} for fiscal year %d.", "company_name", "fiscal_year") for s in sections])
    f = c.crossJoin(F.broadcast(y))
    return f.select("ticker", "company_name", "fiscal_year", F.lit("10-K").alias("form_type"), text.alias("content"), F.sha2(text, 256).alias("content_hash"))


# Sample facilities.
FACILITIES = (("general", "General Hospital", "H001"), ("childrens", "Children's Hospital", "H002"), ("regional", "Regional Medical Center", "H003"))


def synthetic_reports(spark: SparkSession, report_date: str, metrics: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Healthcare reports: two kinds for each facility, with their metrics as a map."""
    rows = [(k, n, i, kind, report_date, (metrics or {}).get(k, {"readmission_rate": 10.0 + j, "patient_satisfaction": 80.0 + j})) for j, (k, n, i) in enumerate(FACILITIES) for kind in ("quality_report", "performance_dashboard")]
    df = spark.createDataFrame(rows, "facility string, facility_name string, facility_id string, document_type string, report_date string, metrics map<string,double>")
    body = F.array_join(F.transform(F.array_sort(F.map_keys("metrics")), lambda k: F.concat(k, F.lit(": "), F.round(F.element_at("metrics", k), 1).cast("string"))), "; ")
    return df.withColumn("content", F.concat("facility_name", F.lit(" "), "document_type", F.lit(" "), body)).withColumn("document_id", F.concat_ws("-", "facility", F.when(F.col("document_type") == "quality_report", "QR").otherwise("PD"), F.date_format(F.to_date("report_date"), "yyyyMM"), F.substring(F.sha2("content", 256), 1, 8)))


class FilingSource(DataSource):
    """``spark.read.format('filings')``: filings from templates, one partition a company; options companies, years."""

    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return FILING

    def reader(self, schema) -> DataSourceReader:
        return _FilingReader(self.options)


class _FilingReader(DataSourceReader):
    def __init__(self, options):
        self.companies = options.get("companies", "AAPL,MSFT").split(",")
        self.years = [int(y) for y in options.get("years", "2022,2023").split(",")]

    def partitions(self):
        return [InputPartition(c) for c in self.companies]

    def read(self, partition):
        cik = str(sum(map(ord, partition.value))).zfill(10)
        for y in self.years:
            yield cik, partition.value, "10-K", f"{y}-10-31", f"{cik}-{y % 100:02d}-000001", f"{partition.value.lower()}-{y}.htm"


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON, one object a row."""
    df.write.mode("overwrite").json(path)
