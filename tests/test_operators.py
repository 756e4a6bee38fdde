"""Operators on small literal frames."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docwright.functions.tokens import BpeCounter
from docwright.operators import metrics as M
from docwright.operators import provenance as P
from docwright.operators import records
from docwright.operators import relational as R
from docwright.operators import retrieval as E
from docwright.operators import structure as S
from docwright.plans import catalogue, promql
from docwright.sources import connectors as C
from docwright.sources import fetch as fetch_module
from docwright.sources import html as H
from docwright.streaming import metrics as SM

T0 = datetime(2024, 1, 1)


def test_upsert_updates_a_subset(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, v int")
    b = spark.createDataFrame([(2, "x", 20), (2, "y", 30), (3, "c", 3)], "k int, name string, v int")
    got = sorted(map(tuple, R.upsert(t, b, ["k"], ["v"], [F.desc("v")]).collect()))
    assert got == [(1, "a", 1), (2, "b", 30), (3, "c", 3)]
    got = sorted(map(tuple, R.insert_if_absent(t, b, ["k"], [F.col("v")]).collect()))
    assert got == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]


def test_keys_and_percentiles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(R.zero_fill(F.lit("320193"))) == "0000320193" and one(R.zero_fill(F.lit("123456789012"))) == "123456789012"
    a = F.array(*map(F.lit, (5, 1, 3)))
    assert [one(R.nearest_rank(a, p)) for p in (0, 50, 95, 100)] == [1, 3, 5, 5]
    df = spark.createDataFrame([("k", v) for v in (5, 1, 3, 3, None)], "k string, v int")
    assert tuple(R.nearest_rank_by_key(df, ["k"], "v", [50, 95]).first()) == ("k", 4, 3, 5)


def test_histogram_quantile(spark):
    def q(p, counts, bounds=(1.0, 2.0, float("inf"))):
        h = spark.createDataFrame([("k", b, n) for b, n in zip(bounds, counts, strict=True)], "k string, le double, cumulative long")
        return M.histogram_quantile(p, h, ["k"]).first()["value"]

    assert q(0.5, (0, 0, 0)) is None
    assert q(0.5, (10, 10, 10)) == 0.5
    assert q(0.5, (5, 10, 10)) == 1.0
    assert q(0.75, (5, 10, 10)) == 1.5
    assert q(0.99, (1, 2, 10)) == 2.0


def ticks(spark, minutes):
    return spark.createDataFrame([("a", T0 + timedelta(minutes=m), on) for m, on in minutes], "k string, ts timestamp, firing boolean")


def test_avg_over_time(spark):
    rng = random.Random(7)
    at = lambda: rng.choice([None, *[T0 + timedelta(seconds=rng.choice((1, 60, 3600)) * rng.randrange(90), microseconds=rng.choice((0, 1)))] * 30])
    rows = [(i, rng.choice(("a", "b", None)), at(), rng.choice((None, round(rng.uniform(-9, 9), 2), 5.0))) for i in range(600)]
    s = spark.createDataFrame(rows, "i int, k string, ts timestamp_ntz, v double")
    for seconds in (1, 60, 7200):

        def mean(key, t, seconds=seconds):
            w = [v for _, k, u, v in rows if k == key and v is not None and (u is None if t is None else u is not None and t - timedelta(seconds=seconds) <= u <= t)]
            return sum(w) / len(w) if w else None

        got = M.avg_over_time(s, ["k"], "ts", "v", seconds)
        assert got.columns == ["i", "k", "ts", "v", "avg_over_time"]
        assert {r["i"]: r["avg_over_time"] for r in got.collect()} == {i: None if (m := mean(k, t)) is None else pytest.approx(m, abs=1e-9) for i, k, t, _ in rows}


def test_avg_over_time_does_not_grow_with_its_window(spark):
    s = spark.range(60_000).select(F.lit("a").alias("k"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.lit(1.0).alias("v"))
    begun = time.time()
    assert M.avg_over_time(s, ["k"], "ts", "v", 10**7).agg(F.sum("avg_over_time")).first()[0] == 60_000
    assert time.time() - begun < 30


def test_avg_over_time_rounds_halves_up(spark, tmp_path):
    """91241.54 / 1856 is 49.1603125, and an ulp less in double precision."""
    value = F.when(F.col("id") == 0, 49.74).otherwise(49.16)
    spark.range(1856).select(F.col("id").alias("event_id"), F.lit(T0).cast("timestamp_ntz").alias("ts"), F.lit("a").alias("event_type"), value.alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    assert {r["avg_over_time"] for r in catalogue.QUERIES["avg_over_time"](spark, str(tmp_path)).collect()} == {49.160313}


def test_alert_hold(spark):
    hold = lambda rows: [tuple(r)[1:] for r in M.alert_hold(ticks(spark, rows), ["k"], "ts", F.col("firing"), 600).collect()]
    on = lambda n: [(m, True) for m in range(n + 1)]
    assert hold(on(9)) == []
    assert hold(on(10)) == [(T0, T0 + timedelta(minutes=10), T0 + timedelta(minutes=10))]
    assert hold(on(11))[0][2] == T0 + timedelta(minutes=10)
    assert hold([(m, m % 2 == 0) for m in range(60)]) == []


def test_budget(spark):
    def at(spent, model="gpt-4o"):
        return tuple(spark.range(1).select(M.budget_status(F.lit(100.0), F.lit(spent), F.lit(model)).alias("b")).first()["b"])

    assert at(50.0) == (50.0, 0.5, "normal", True, None)
    assert at(85.0) == (15.0, 0.85, "warning", True, "gpt-4o-mini")
    assert at(95.0) == (5.0, 0.95, "critical", True, "claude-3-haiku")
    assert at(120.0) == (0.0, 1.0, "exhausted", False, None)
    assert at(85.0, "gpt-3.5-turbo")[3:] == (True, None)
    cost = spark.range(1).select(M.token_cost(F.lit("gpt-4o"), F.lit(1000), F.lit(2000)).alias("a"), M.token_cost(F.lit("none"), F.lit(1), F.lit(1)).alias("b"), M.request_estimate(F.lit("gpt-4-turbo"), F.lit(1000)).alias("c")).first()
    assert tuple(cost) == pytest.approx((0.035, 0.0, 0.002))


def test_retrieval_scores(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, vec_id long, rank int")
    exp = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "query_id long, vec_id long")
    got = {r["query_id"]: r for r in E.retrieval_scores(hits, exp).collect()}
    assert got[1]["ndcg"] == pytest.approx(0.5 / 1.5) and got[1]["recall"] == 0.5 and got[1]["mrr"] == 0.5
    assert got[2]["ndcg"] == 0 and got[2]["mrr"] == 0
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(E.faithfulness(F.lit("The answer"), F.array().cast("array<string>"))) == 0.5
    assert one(E.relevance(F.lit("a b"), F.lit(""))) == 0.0
    assert one(E.id_overlap(F.array(*map(F.lit, range(5))), F.array(*map(F.lit, range(1, 6))))) == "overlap"
    assert one(E.keyword_hits(F.lit("Revenue was 3 billion"), F.array(F.lit("revenue"), F.lit("loss")))) is True


PAGE = """<html><head><title>t</title></head><body><div class="Nav">menu</div><p style="display: none">gone</p><p>One&nbsp;“two”</p><!-- c -->
<p>Table of Contents</p><p>12</p><script>x()</script><div><b>Consolidated Balance Sheet</b></div><div><table><tr><th>A<th colspan=2>B</tr><tr></tr><tr><td>1<td>2<td>3</table></div></body></html>"""


def test_html():
    text = H.clean(PAGE)
    assert 'One "two"' in text and "gone" not in text and "Contents" not in text and "x()" not in text
    assert H.page_text(PAGE).split("\n")[0] != "menu" and "menu" not in H.page_text(PAGE)
    assert H.tables(PAGE) == [("Consolidated Balance Sheet", [["A", "B", "B"], ["1", "2", "3"]])]
    assert H.clean(None) == "" and H.tables("") == []
    assert H.metadata("<p>CENTRAL INDEX KEY: 320193</p>")["cik"] == "0000320193"
    assert H.caption_of(next(H.parse('<p style="font-weight:700">Loans</p>').find_all("p"))) == "Loans"


def test_header_rows_and_types(spark):
    def rows(*r):
        return spark.createDataFrame([([list(map(str, x)) for x in r],)], "r array<array<string>>").select(S.header_rows(F.col("r")).alias("n")).first()["n"]

    assert rows(["", "2024"], ["Cash", "5"]) == 1
    assert rows(["", "Years ended"], ["", "2024"], ["Cash", "$5"]) == 2
    assert rows(["a", "b"], ["1", "2"]) == 1
    assert rows(["only"]) == 1
    kind = lambda t: spark.range(1).select(S.table_type(F.lit(t)).alias("x")).first()["x"]
    assert kind("Consolidated Balance Sheets") == "balance_sheet" and kind("Net sales") == "other" and kind("Operating lease cost") == "lease_obligations"


def test_amounts_are_no_years(spark):
    rows = [["", "Years ended"], ["", "2024", "2023"], ["Net sales", "$1999", "$383,285"], ["Loss", "(1,234)", "12.5%"]]
    t = spark.createDataFrame([(1, 0, None, rows)], "id int, position int, caption string, rows array<array<string>>")
    both = [S.process_tables(t, strict_reference=strict).select("header_count", F.size("data_rows")).first() for strict in (False, True)]
    assert list(map(tuple, both)) == [(2, 2), (3, 1)]
    count = lambda *r: spark.createDataFrame([(list(r),)], "r array<array<string>>").select(S.header_rows(F.col("r")).alias("n")).first()["n"]
    head = ["", "2024"]
    assert [count(head, ["Cash", c], ["Debt", "5"]) for c in ("$2001", "€ 1999", "($2000)", "$(2000)")] == [1] * 4
    # Years stay years beside amounts, and at the place of a row whose number they begin or end with.
    assert count(head, ["$5 notes due", "2031"], ["Debt", "5"]) == 2 and count(["", "2011"], ["2010", "2021"], ["Debt", "5"]) == 2


def test_values_of_the_first_data_row(spark):
    rows = [["", "Sept 2024", "Sept 2023"], ["Net sales", "$1901", "$2000"], ["Loss", "(1,234)", "12.5%"]]
    t = spark.createDataFrame([(1, 0, None, rows)], "id int, position int, caption string, rows array<array<string>>")
    v = S.process_tables(t, values=True).select(F.expr("transform(values[0], c -> struct(c.value_type, double(c.value)))").alias("v")).first()["v"]
    assert list(map(tuple, v)) == [("text", None), ("currency", 1901.0), ("currency", 2000.0)]


def test_table_values_of_any_page(spark, tmp_path):
    """Amounts of fifteen and more digits, signs behind the symbol, and pages without html."""
    ids = [5, 99999999999999, 100000000000001, 1000000000002499, 2**62 + 1025, 2**63 - 1, -1, -1999, -(2**62), -(2**63)]
    spark.createDataFrame([(i, "u", None if i == 5 else "<p>a<br>") for i in ids], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["cell"]): (r["value"], r["value_type"]) for r in catalogue.QUERIES["table_values"](spark, str(tmp_path)).collect()}
    assert got == {(i, c): v for i in ids for c, v in enumerate([(None, "text"), (float(i), "currency"), (383285.0, "currency")])}


def test_chunker():
    c = S.Chunker()
    short = c.chunks("# A\nfew words here", "d")
    assert [x["chunk_type"] for x in short] == ["text"] and short[0]["heading"] == "A"
    assert c.chunks("| a | b |\n| - | - |\n| 1 | 2 |\n", "d")[0]["chunk_type"] == "table"
    sentence = lambda n, w="w": " ".join([w] * (n - 1) + ["end."])
    text = " ".join(sentence(40, f"s{i}") for i in range(20))
    made = c.chunks(text, "d")
    assert all(x["token_count"] <= 300 for x in made) and {w for x in made for w in x["content"].split()} == set(text.split())
    assert made[1]["content"].startswith("s6 ")
    assert [x["token_count"] for x in c.chunks(sentence(500), "d")] == [400, 100]
    first = sentence(350) + " " + sentence(100)
    assert [x["token_count"] for x in c.chunks(first, "d")][0] == 350
    assert [x["token_count"] for x in S.Chunker(strict_reference=True).chunks(first, "d")][0] == 0
    lead = "Text before.\n# Head\nbody"
    assert len(c.chunks(lead, "d")) == 2 and len(S.Chunker(strict_reference=True).chunks(lead, "d")) == 1
    lines = "# One\n1.2 Title here\nITEM 1A. Risk\nPart iv: The rest\n#### four\n#none\n3 lower\n2.1 Ends. here\nItem x2 Foo\nitem 7 b\n"
    assert [h[1:] for h in S.headings(lines)] == [("One", 1), ("1.2 Title here", 2), ("ITEM 1A. Risk", 1), ("Part iv: The rest", 1), ("item 7 b", 1)]
    assert all(lines[a:].startswith(h.split()[0]) or lines[a] == "#" for a, h, _ in S.headings(lines))
    assert S.table_regions("a <TABLE x><tr></table > b <tables></table>\n|a|\n|b|\n|c|\nend\n|a|\n|b|\n") == [(2, 24), (44, 56)]
    assert S.budget_chunks("a b") == S.budget_chunks("a  b") and len(S.budget_chunks("word " * 300)) > 2


def test_subword_counts(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    counter = BpeCounter(vocabularies.path("byte_bpe_50k.json"))
    texts = ["", None, "internationalisation of antidisestablishment", "\n\n 12,345.67 €", "x" * 5000]
    got = records.token_counts(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "t", counter).collect()
    assert {r["i"]: r["n_tokens"] for r in got} == {i: size(t) if t else 0 for i, t in enumerate(texts)}
    long = "# Antidisestablishment\n" + " ".join(f"Incomprehensibilities {i} were unquestionably institutionalised." for i in range(120))
    chunks = S.Chunker(count=counter).chunks(long, "d")
    assert len(chunks) > len(S.Chunker().chunks(long, "d")) and all(size(c["content"]) <= 400 for c in chunks)


def test_provenance(spark):
    d = spark.createDataFrame([("u1", "text"), ("u0", "text")], "url string, text string")
    docs = P.register_documents(d, F.col("url"))
    assert [r["source_url"] for r in docs.collect()] == ["u0"]
    h = docs.first()["document_hash"]
    chunks = spark.createDataFrame([(h, "te"), ("other", "x")], "document_hash string, content string")
    ok, bad = P.register_chunks(chunks, docs)
    assert (ok.count(), bad.count()) == (1, 1)
    got = {len(r["chain"]) for r in P.chains(ok.union(bad), docs).collect()}
    assert got == {2, 3}


def series(spark):
    rows = [("hits", {"job": j, "code": c}, T0 + timedelta(minutes=m), float(v)) for j, c, vs in (("a", "200", (0, 60, 120, 180)), ("a", "500", (0, 30, 5, 10)), ("b", "200", (0, 6, 12, 18))) for m, v in enumerate(vs)]
    rows += [("lat_bucket", {"le": le}, T0 + timedelta(minutes=m), n * m) for le, n in (("1", 5.0), ("2", 10.0), ("+Inf", 10.0)) for m in range(4)]
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("2 + 3 * 4", [({}, 14.0)]),
        ('hits{job="b"}', [({"job": "b", "code": "200"}, 18.0)]),
        ('sum(increase(hits{code=~"5.*"}[5m]))', [({}, 40.0)]),
        ('rate(hits{job="a",code!="500"}[4m])', [({"job": "a", "code": "200"}, 180 / 240)]),
        ("sum by (job) (hits)", [({"job": "a"}, 190.0), ({"job": "b"}, 18.0)]),
        ("sum(hits) without (code) > 100", [({"job": "a"}, 190.0)]),
        ('avg_over_time(hits{job="b"}[10m])', [({"job": "b", "code": "200"}, 9.0)]),
        ('hits{job="b"} offset 2m', [({"job": "b", "code": "200"}, 6.0)]),
        ("histogram_quantile(0.75, sum(rate(lat_bucket[5m])) by (le))", [({}, 1.5)]),
        ("sum(missing) or vector(7)", [({}, 7.0)]),
        ("100 * hits{job=\"b\"} / hits{job=\"b\"}", [({"job": "b", "code": "200"}, 100.0)]),
        ("-sum(hits{job='x'} or hits{job=\"b\"})", None),
    ],
)
def test_promql(spark, expression, want):
    if want is None:
        with pytest.raises(promql.PromQLError):
            promql.evaluate(expression, series(spark), [T0 + timedelta(minutes=3)])
        return
    got = [(r["labels"], r["value"]) for r in promql.evaluate(expression, series(spark), [T0 + timedelta(minutes=3)]).collect()]
    key = lambda x: sorted(x[0].items())
    assert [(a, pytest.approx(b)) for a, b in sorted(want, key=key)] == sorted(got, key=key)


@pytest.mark.parametrize("name", ["increase", "sum_over_time", "min_over_time", "max_over_time", "count_over_time", "avg_over_time"])
def test_overlapping_windows_by_brute_force(spark, name):
    rng = random.Random(5)
    rows = [(job, T0 + timedelta(seconds=rng.randrange(20000)), float(rng.randrange(50))) for job in "ab" for _ in range(300)]
    rows = list({(j, t): (j, t, v) for j, t, v in rows}.values())
    df = spark.createDataFrame([("m", {"job": j}, t, v) for j, t, v in [*rows, ("a", T0, None)]], "metric string, labels map<string,string>, ts timestamp, value double")
    at = [T0 + timedelta(seconds=37 * i) for i in range(400)] + [T0 - timedelta(days=1), T0]
    got = {(r["at"], r["labels"]["job"]): r["value"] for r in promql.evaluate(f"{name}(m[13m] offset 90s)", df, at).collect()}
    want = {}
    for t in set(at):
        for job in "ab":
            upto = t - timedelta(seconds=90)
            vs = [v for _, v in sorted((x, v) for j, x, v in rows if j == job and upto - timedelta(minutes=13) < x <= upto)]
            if name == "increase":
                if len(vs) > 1:
                    want[t, job] = sum(b if b < a else b - a for a, b in zip(vs, vs[1:], strict=False))
            elif vs:
                want[t, job] = {"sum": sum(vs), "min": min(vs), "max": max(vs), "count": len(vs), "avg": sum(vs) / len(vs)}[name.split("_")[0]]
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(got) > 500


@pytest.mark.parametrize("first", range(9))
def test_dyadic_runs_cover_each_segment_once(first):
    for end in range(first, 40):
        assert sorted(s for level, node in promql.dyadic(first, end) for s in range(node << level, (node + 1) << level)) == list(range(first, end))


@pytest.mark.parametrize("bad", ["sum(", "hits[5m]", "rate(hits[0m])", "rate(hits)", "nope(hits)", "1 +", "hits{a~\"x\"}"])
def test_promql_errors(spark, bad):
    with pytest.raises((promql.PromQLError, IndexError)):
        promql.evaluate(bad, series(spark), [T0])


def test_sources(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"id": "q1", "query": "x", "expected_doc_ids": ["d"], "category": "c"}\n\n')
    assert C.json_lines(spark, str(p)).count() == 1
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        C.json_lines(spark, str(p)).collect()
    assert C.json_lines(spark, str(tmp_path / "none"), fallback=spark.range(2)).count() == 2
    df = spark.createDataFrame([("0000320193", "10-K", "a"), ("0000000001", "10-Q", "b")], "cik string, form_type string, content string")
    out = str(tmp_path / "bronze")
    C.documents_written(df, out)
    C.documents_written(df.limit(1), out)
    assert spark.read.parquet(out).count() == 2 and (tmp_path / "bronze" / "cik=320193").exists()
    C.export_records(df, str(tmp_path / "json"), ["cik"])
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.html").write_text("<p>x\ny</p>")
    assert C.objects(spark, str(tmp_path / "o")).first()["content"] == "<p>x\ny</p>"
    assert C.objects(spark, str(tmp_path / "o"), text=False).select("length").first()[0] == 10
    spark.dataSource.register(C.FilingSource)
    assert spark.read.format("filings").option("companies", "A,B").option("years", "2023").load().count() == 2


def test_streams_equal_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(src))
    stream = SM.file_stream(spark, str(src))
    SM.run_available(SM.rate(stream, ["event_type"], late="0 seconds"), str(tmp_path / "rate"), str(tmp_path / "c1"))
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "rate")).collect()}
    batch = M.rate(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "5 minutes", 300.0)
    want = {(r["window_start"], r["event_type"]): r["n"] for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > 0.9 * len(want)
    SM.run_available(SM.quantile(SM.histogram(stream, ["event_type"], every="1 day", late="0 seconds"), 0.95), str(tmp_path / "h"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "h")).filter("value > 0").count() > 0


def test_stateful_streams(spark, tmp_path):
    src = tmp_path / "t"
    ticks(spark, [(m, m < 20 or m > 25) for m in range(40)]).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("k string, ts timestamp, firing boolean").parquet(str(src))
    SM.run_available(SM.alert_hold(stream, "k", "ts", "firing", 600), str(tmp_path / "a"), str(tmp_path / "ca"))
    got = sorted(r["fires_at"] for r in spark.read.parquet(str(tmp_path / "a")).collect())
    assert got == [T0 + timedelta(minutes=10), T0 + timedelta(minutes=36)]
    spend = spark.createDataFrame([("x", datetime(2024, 1, 5), 2.0), ("x", datetime(2024, 1, 6), 3.0), ("x", datetime(2024, 2, 1), 4.0)], "tenant string, ts timestamp, cost double")
    spend.coalesce(1).write.parquet(str(tmp_path / "s"))
    q = SM.monthly_spend(spark.readStream.schema("tenant string, ts timestamp, cost double").parquet(str(tmp_path / "s")), "tenant", "ts", "cost")
    q.writeStream.outputMode("update").format("memory").queryName("spend").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cs")).start().awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from spend").collect()] == [("x", "2024-02", 4.0)]


def test_silent_keys_lose_their_state(spark, tmp_path):
    folder = tmp_path / "t"
    schema = "k string, ts timestamp, firing boolean"
    minutes = [[("a", 0), ("a", 5)], [("b", 600)], [("b", 605)], [("a", 700)], [("a", 706), ("a", 712)]]
    for batch in minutes:
        spark.createDataFrame([(k, T0 + timedelta(minutes=m), True) for k, m in batch], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = SM.alert_hold(spark.readStream.schema(schema).parquet(str(folder)), "k", "ts", "firing", 600, late="1 minute", idle_seconds=3600)
        SM.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted((r["k"], r["since"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", T0 + timedelta(minutes=700))]


def test_containing_by_brute_force(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(("a", "bb", "c\nd", "", "é")) for _ in range(n))
    texts = [(i, words(rng.randrange(40))) for i in range(150)] + [(200, None), (201, "")]
    items = [(i, t[a : a + rng.randrange(1, 30)]) for i, t in texts[:60] for a in [rng.randrange(20)]] + [(300, None), (301, "a bb a bb zz c"), (302, "x")]
    got = R.containing(spark.createDataFrame(texts, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, item string"), "i", "item")
    want = sorted((d, i) for d, t in texts for i, x in items if t is not None and x is not None and x in t)
    assert sorted((r["d"], r["i"]) for r in got.collect()) == want


def test_jdbc_appends_in_batches(spark):
    url = "jdbc:derby:memory:docwright;create=true"
    df = spark.createDataFrame([(i, f"name {i}") for i in range(250)], "id long, name string")
    for part in (df.filter("id < 100"), df.filter("id >= 100")):
        records.write_jdbc(part, url, "items", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    got = spark.read.format("jdbc").options(url=url, dbtable="items", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").load()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_replace_documents_keeps_the_others(spark, tmp_path):
    out = str(tmp_path / "chunks")
    row = lambda d, c: (c, d)
    kind = "content string, document_id string"
    C.replace_documents(spark.createDataFrame([row("a", "1"), row("a", "2"), row("b", "3")], kind), out)
    C.replace_documents(spark.createDataFrame([row("a", "9")], kind), out)
    assert sorted((r["document_id"], r["content"]) for r in spark.read.parquet(out).collect()) == [("a", "9"), ("b", "3")]


def test_recent_objects(spark):
    f = spark.createDataFrame([("gold/1/AAPL/kpi.json", datetime(2024, 1, 9)), ("gold/1/MSFT/kpi.json", datetime(2024, 1, 1))], "path string, modificationTime timestamp")
    got = C.recent_objects(f, F.lit(datetime(2024, 1, 10))).collect()
    assert [(r["cik"], r["ticker"], r["kind"]) for r in got] == [("1", "AAPL", "kpi")]


def test_exact_topk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 2)
    rows = [(i, [float(i % 5), float(i % 3) - 1, 1.0]) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in df.collect())
    assert key(E.vector_topk(q, v, 4)) == key(E.vector_topk(q, v, 4, exact=False))
    tagged = v.withColumn("tenant_id", F.when(F.col("vec_id") < 10, "a").otherwise("b"))
    assert {r["vec_id"] < 10 for r in E.vector_topk(q, tagged, 3, tenant="a").collect()} == {True}


@pytest.mark.parametrize("wide", [4, 128])
def test_topk_by_expressions_with_bounds(spark, monkeypatch, wide):
    """Few chunks give the bounds, queries stand in several blocks, and many scores are equal."""
    for name, n in (("FIRST", 8), ("SHARD", 3), ("PAIRS", 50), ("WIDE", wide)):
        monkeypatch.setattr(E, name, n)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(5)] + [1.0]) for i in range(60)]
    odd = [(100, None), (101, [0.0] * 6), (102, [1.0, None, 0.0, 0.0, 0.0, 1.0]), (103, [float("nan")] * 6), (104, [1.0]), (105, [])]
    v = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())
    q = v(rows).filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    want = key(E.vector_topk(q, v(rows), 4))
    all_queries = q.union(v(odd).filter("vec_id <> 104"))
    assert len(want) == 28 and key(E.vector_topk(all_queries, v(rows + odd), 4, exact=False)) == want


def test_deep_pages_and_wide_cells():
    deep = "<div>" * 100_000 + "long enough" + "</div>" * 100_000
    assert H.clean(deep) == "long enough"
    assert H.page_text(deep) == "long enough"
    assert H.metadata(deep)["cik"] is None
    assert H.tables(deep) == []
    rows = H.tables('<table><tr><td colspan="1000000000">a</td><td colspan="2">b</td></tr></table>')[0][1]
    assert len(rows[0]) == 1002


def test_long_event_lines_are_whole(spark):
    text = "x" * 2_000_000
    lines = spark.createDataFrame([("r", 0, 'data: {"type": "token", "content": "' + text + '"}'), ("r", 1, 'data: {"type": "done"}')], "request_id string, seq int, line string")
    row = C.answer_events(lines).first()
    assert len(row["answer"]) == 2_000_000 and row["done"]


def test_foreign_chunks_are_orphans(spark):
    docs = P.register_documents(spark.createDataFrame([("a", "text one"), ("b", "text two"), ("c", "text one")], "url string, text string"), F.col("url"))
    known = [r["document_hash"] for r in docs.collect()]
    chunks = spark.createDataFrame([(known[0], "x"), (known[1], "y"), ("0" * 64, "z")], "document_hash string, content string")
    ok, bad = P.register_chunks(chunks, docs)
    assert (ok.count(), [r["content"] for r in bad.collect()]) == (2, ["z"])
    chain = {r["chunk_hash"]: len(r["chain"]) for r in P.chains(ok.unionByName(bad), docs).collect()}
    assert sorted(chain.values()) == [2, 3, 3]


def test_fetch_pages_retries_and_skips(spark):
    def fetch(key, token):
        if key == "down":
            raise TimeoutError("no answer")
        if key == "bad":
            raise ValueError("no such key")
        page = int(token or 0)
        return [f'{{"k": "{key}", "n": {page * 2 + i}}}' for i in range(2)], str(page + 1) if page < 2 else None

    keys = spark.createDataFrame([("a",), ("b",), ("down",), ("bad",), (None,), ("a",)], "cik string")
    rows = fetch_module.fetch_records(keys, "cik", fetch, tasks=2, per_second=1000.0, most=5, first_wait=0.001).collect()
    good = [(r["key"], r["seq"]) for r in rows if r["error"] is None]
    assert sorted(good) == [(k, i) for k in "ab" for i in range(5)]
    assert {r["key"]: r["error"].split(":")[0] for r in rows if r["error"]} == {"down": "TimeoutError", "bad": "ValueError"}


def test_pace_and_retries():
    now, slept = [0.0], []
    sleep = lambda s: (slept.append(round(s, 6)), now.__setitem__(0, now[0] + s))
    pace = fetch_module.Pace(0.1, lambda: now[0], sleep)
    for _ in range(4):
        pace.wait()
    assert slept == [0.1, 0.1, 0.1]
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise ConnectionError
        return "ok"

    assert fetch_module.with_retries(flaky, 3, 1.0, waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(ConnectionError):
        fetch_module.with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), 2, 1.0, waits.append)
