"""Text, guard, dialogue and provenance queries over documents, conversations, benchmark and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.functions import text as T
from docwright.operators import relational
from docwright.operators import retrieval as R

from .registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(rf"""SELECT doc_id, length(text)::INT AS chars, len({WORDS})::INT AS words, len(string_split(text, chr(10)))::INT AS lines,
len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> ''))::INT AS paragraphs FROM documents""")
def text_stats(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def one_line(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.one_line(F.col("text")).alias("text"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) >= 3 AND NOT regexp_matches(s, '(?i)Table of Contents|Return to Index|^\s*\d+\s*$|UNITED STATES\s+SECURITIES AND EXCHANGE COMMISSION|Washington,?\s+D\.?C\.?\s+\d{5}|Commission File Number:?\s*\d+-\d+')), chr(10)) AS text FROM documents")
def line_boilerplate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.drop_boilerplate(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(replace(regexp_replace(text, ' {2,}', ' ', 'g'), chr(9), ' '), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda s: trim(s)), chr(10)) AS text FROM documents""")
def whitespace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(r"SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, chr(160), ' '), chr(8203), ''), chr(8216), ''''), chr(8217), ''''), chr(8220), '\"'), chr(8221), '\"'), chr(8211), '-'), chr(8212), '--'), chr(8230), '...') AS text FROM documents".replace('\\"', '"'))
def plain_characters(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize_characters(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'us-gaap:[A-Za-z0-9]+', '', 'g'), 'dei:[A-Za-z0-9]+', '', 'g'), '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}', '', 'g'), 'https?://\S+', '', 'g'), ' ') AS text FROM documents")
def filing_marks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.strip_filing_marks(F.col("text"), urls=True).alias("text"))


def _windows(name, size, stride, least):
    @query(rf"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), {stride})) AS s FROM w)
SELECT doc_id, (s // {stride})::INT AS i, array_to_string(list_slice(w, s + 1, s + {size}), ' ') AS text, least({size}, len(w) - s)::INT AS n FROM s WHERE least({size}, len(w) - s) >= {least}""", name)  # fmt: skip
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", F.explode(T.word_windows(F.col("text"), size, stride, least)).alias("c")).select("doc_id", "c.*")


for _name, _size, _stride, _least in (("word_windows_500", 500, 400, 50), ("word_windows_400", 400, 320, 40), ("word_windows_512", 512, 384, 51), ("word_windows_512_all", 512, 384, 1)):
    _windows(_name, _size, _stride, _least)


@query(rf"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), k AS (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - 100) / 400.0))::BIGINT END)) AS i FROM w)
SELECT doc_id, i::INT AS i, array_to_string(list_slice(w, i * 400 + 1, i * 400 + 500), ' ') AS text, least(500, len(w) - i * 400)::INT AS n FROM k""")
def stop_windows(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(T.word_windows_to_end(F.col("text"))).alias("c")).select("doc_id", "c.*")


def _chars(preset):
    size, overlap = T.PRESETS[preset]

    @query(rf"""WITH k AS (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - {overlap}) / {size - overlap}.0))::BIGINT END)) AS j FROM documents),
c AS (SELECT doc_id, j, j * {size - overlap} AS s, substr(text, j * {size - overlap} + 1, {size}) AS t, length(text) AS n FROM k)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1)::INT AS i, s::INT AS "start", least(s + {size}, n)::INT AS "end", t AS text FROM c WHERE trim(regexp_replace(t, '\s+', ' ', 'g')) <> ''""", f"char_windows_{preset}")  # fmt: skip
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", F.explode(T.char_windows(F.col("text"), preset)).alias("c")).select("doc_id", "c.*")


for _preset in ("small", "default", "large"):
    _chars(_preset)


@query("SELECT doc_id, CASE WHEN n_chars % 10 > 7 THEN 'large' WHEN n_chars > 800 THEN 'small' WHEN doc_id % 5 < 3 THEN 'semantic' ELSE 'default' END AS preset FROM documents")
def preset_recommendation(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", T.recommended_preset((F.col("n_chars") % 10) / 10, F.col("n_chars").cast("double"), (F.col("doc_id") % 5) / 5, F.lit(None).cast("string")).alias("preset"))


@query("SELECT sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def content_hash(spark, sf_dir):
    h = docs(spark, sf_dir).select("doc_id", *[T.content_hash(F.col("text"), a).alias(a) for a in ("sha256", "md5", "sha1")])
    return h.groupBy("sha256", "md5", "sha1").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT conv_id, turn, left(sha256('t' || conv_id % 3 || ':' || lower(trim(text))), 32) AS tenant_key, left(sha256(lower(trim(text))), 32) AS plain_key FROM conversations WHERE role = 'user'")
def cache_key(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", T.cache_key(F.col("text"), F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string"))).alias("tenant_key"), T.cache_key(F.col("text")).alias("plain_key"))


KEY = "|".join(T.KEYWORDS)


@query(rf"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 50 AND length(x) < 1000 AND regexp_matches(lower(x), '{KEY}')) AS f FROM documents)
SELECT doc_id, 'Filing' || chr(10) || CASE WHEN len(f) > 0 THEN array_to_string(list_transform(f[1:200], lambda x: x || '.'), ' ') ELSE substr(text, 1, 30000) END AS content FROM s""")
def keyword_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.keyword_sentences(F.col("text"), F.lit("Filing\n")).alias("content"))


PIPE_ROW = r"(?m)^[^\n|]*\|[^\n]*$"


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: contains(s, '|')))::INT AS rows FROM documents WHERE contains(text, '|')")
def pipe_table_rows(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.contains("text", F.lit("|"))).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda s: F.contains(s, F.lit("|")))).alias("rows"))


@query(rf"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 400)) AS s FROM w), c AS (SELECT least(500, len(w) - s) AS n FROM s WHERE least(500, len(w) - s) >= 50)
SELECT count(*) AS chunks, coalesce(sum(n), 0)::BIGINT AS tokens, round(coalesce(avg(n), 0), 6) AS average FROM c""")
def chunk_stats(spark, sf_dir):
    c = docs(spark, sf_dir).select(F.explode(T.word_windows(F.col("text"), 500, 400, 50)).alias("c"))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("c.n"), F.lit(0)).cast("long").alias("tokens"), F.round(F.coalesce(F.avg("c.n"), F.lit(0.0)), 6).alias("average"))


JAIL = " ".join(f"WHEN contains(lower(text), '{p}') THEN '{p}'" for p in T.JAILBREAK)


@query(f"""WITH g AS (SELECT conv_id, turn, length(text) > 500 AS long, CASE {JAIL} END AS hit FROM conversations)
SELECT conv_id, turn, NOT long AND hit IS NULL AS passed, CASE WHEN long THEN 'input_validation' WHEN hit IS NOT NULL THEN 'jailbreak_detector' END AS blocked_by, CASE WHEN NOT long THEN hit END AS pattern FROM g""")
def guard_pre(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.guard_question(F.col("text")).alias("g")).select("conv_id", "turn", "g.*")


@query(r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL_REDACTED]', 'g') AS t FROM documents),
b AS (SELECT *, regexp_replace(t, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '[PHONE_REDACTED]', 'g') AS u FROM a), c AS (SELECT *, regexp_replace(u, '\b\d{3}-\d{2}-\d{4}\b', '[SSN_REDACTED]', 'g') AS v FROM b)
SELECT doc_id, v AS text, concat_ws(',', CASE WHEN t <> text THEN 'email' END, CASE WHEN u <> t THEN 'phone' END, CASE WHEN v <> u THEN 'ssn' END) AS kinds FROM c""")
def redact(spark, sf_dir):
    r = docs(spark, sf_dir).select("doc_id", T.redact(F.col("text")).alias("r"))
    return r.select("doc_id", "r.text", F.array_join("r.kinds", ",").alias("kinds"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'hate') THEN 'hate' WHEN contains(lower(text), 'violence') THEN 'violence' WHEN contains(lower(text), 'offensive') THEN 'offensive' END AS flagged FROM documents")
def moderation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.moderate(F.col("text")).alias("flagged"))


@query(rf"""WITH q AS (SELECT conv_id, turn, regexp_matches(lower(text), 'calculate|compare|change|growth') AS calc, len({WORDS}) > 20 OR contains(lower(text), 'complex') AS hard FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN calc OR hard THEN 'gpt-4-turbo' ELSE 'gpt-3.5-turbo' END AS model, CASE WHEN calc THEN 'calculation_required' WHEN hard THEN 'complex_query' ELSE 'simple_query' END AS reason FROM q""")
def route_model(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", T.route_model(F.col("text")).alias("r")).select("conv_id", "turn", "r.*")


PAIRS = """p AS (SELECT q.conv_id, q.turn, min(q.text) AS question, min(a.text) AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user' GROUP BY 1, 2)"""


def pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.filter("role = 'user'").join(a, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.min("text").alias("question"), F.min("answer").alias("answer"))


SETS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda w: w <> ''))"


@query(rf"""WITH {PAIRS}, s AS (SELECT *, {SETS.format(c='question')} AS a, {SETS.format(c='answer')} AS b FROM p), o AS (SELECT *, coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(a), 0), 0.0) AS o FROM s)
SELECT conv_id, turn, round(CASE WHEN length(answer) = 0 THEN 0.0 ELSE least(1.0::DOUBLE, (o + least(1.0::DOUBLE, length(answer)::DOUBLE / 100)) / 2 + 0.3) END, 9) AS runner, round(CASE WHEN length(answer) > 50 THEN least(1.0::DOUBLE, o + 0.3) ELSE 0.3 END, 9) AS nightly FROM o""")
def relevance(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", *[F.round(R.relevance(F.col("question"), F.col("answer"), v), 9).alias(v) for v in ("runner", "nightly")])


@query(rf"""WITH {PAIRS} SELECT conv_id, turn, CASE WHEN contains(lower(answer), lower(substr(question, 1, 50))) THEN 1.0 ELSE 0.0 END::DOUBLE AS runner, CASE WHEN contains(answer, question) THEN 1.0 ELSE 0.0 END::DOUBLE AS nightly FROM p""")
def faithfulness(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", *[R.faithfulness(F.col("answer"), F.array("question"), v).alias(v) for v in ("runner", "nightly")])


@query("""WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations)
SELECT conv_id, string_agg('[' || i || '] ' || substr(text, 1, 800), chr(10) || chr(10) ORDER BY i) AS context FROM r WHERE i <= 5 GROUP BY 1""")
def context_assembly(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", T.context(F.transform("t", lambda t: t["text"])).alias("context"))


@query("SELECT doc_id, source AS tenant, 'analyst,' || lang AS roles FROM documents")
def tenant_roles(spark, sf_dir):
    groups = F.array(F.lit("analyst"), F.concat(F.lit("tenant_"), F.col("source")), F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", T.tenant(F.lit(""), groups).alias("t")).select("doc_id", "t.tenant", F.array_join("t.roles", ",").alias("roles"))


@query("""SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS "start", strpos(d.text, b.text) - 1 + length(b.text) AS "end", len(string_split(substr(d.text, 1, strpos(d.text, b.text) - 1), chr(10))) AS first_line,
len(string_split(substr(d.text, 1, strpos(d.text, b.text) - 1 + length(b.text)), chr(10))) AS last_line FROM documents d JOIN benchmark b ON strpos(d.text, b.text) > 0""")
def span_offsets(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item")
    hit = relational.containing(docs(spark, sf_dir), "doc_id", "text", b, "item_id", "item")
    s = hit.select("doc_id", "item_id", T.span(F.col("text"), F.col("item")).alias("s"))
    return s.select("doc_id", "item_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("start", "end", "first_line", "last_line")])


@query("SELECT doc_id, doc_id % 2 = 0 AS valid, CASE WHEN doc_id % 2 = 0 THEN 'hash verified' ELSE 'hash mismatch' END AS message FROM documents")
def verify_hash(spark, sf_dir):
    d = F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("0")
    return docs(spark, sf_dir).select("doc_id", T.verify_hash(F.col("text"), d).alias("v")).select("doc_id", "v.*")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("h1"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda s: string_split(trim(s), '  '))), lambda p: trim(p)), lambda p: p <> ''), chr(10)) AS text FROM documents")
def phrase_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.phrases(F.col("text")).alias("text"))


DOMAIN = T.HEALTHCARE | T.FINANCE
MENTIONS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i){p}'), lambda x: trim(x)))), '|') AS mentions FROM t" for k, p in DOMAIN.items())


# DuckDB's word boundaries are those of ASCII: other letters become underscores there, other signs become a hash.
PLAIN = r"t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{80}-\x{BF}\x{2000}-\x{2BFF}\x{3000}-\x{303F}]', '#', 'g'), '[\x{C0}-\x{10FFFF}]', '_', 'g') AS text FROM documents)"


@query(f"WITH {PLAIN} SELECT * FROM ({MENTIONS}) WHERE mentions <> ''")
def domain_entities(spark, sf_dir):
    e = docs(spark, sf_dir).select("doc_id", F.explode(T.entities(F.col("text"), DOMAIN)).alias("kind", "found"))
    return e.select("doc_id", "kind", F.array_join("found", "|").alias("mentions"))
