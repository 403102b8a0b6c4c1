"""Record, trace, page and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import exchanges as X
from ..operators import records as R
from ..operators import split as S
from ..operators import split_lines as L
from ..operators.containment import page_of
from ..operators.scorers import judged
from ..operators.shared import shared_folder
from ..sources import html as H
from ..streaming import conversations as C
from .registry import query, table

_TYPED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'term' WHEN 2 THEN 'audit_case' END AS record_type, text,
 CASE WHEN doc_id % 8 = 1 THEN '' ELSE source END AS term, CASE WHEN doc_id % 3 = 0 THEN lang END AS question, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS answer, text AS body,
 lang AS facts, source AS violation, CASE WHEN doc_id % 7 = 0 THEN lang END AS basis FROM documents"""


def _typed(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("documents_")
    return spark.sql(_TYPED.replace("FROM documents", "FROM documents_"))


@query(f"""SELECT doc_id, CASE record_type WHEN 'audit_case' THEN '사실관계: ' || coalesce(facts, '') || chr(10) || chr(10) || '지적사항: ' || coalesce(violation, '') || chr(10) || chr(10) || '판단근거: ' || coalesce(basis, '')
 WHEN 'term' THEN CASE WHEN coalesce(term, '') <> '' THEN term || ': ' || coalesce(text, '') ELSE coalesce(text, '') END WHEN 'paragraph' THEN coalesce(text, '')
 ELSE CASE WHEN coalesce(question, '') <> '' OR coalesce(answer, '') <> '' THEN '질의: ' || coalesce(question, '') || chr(10) || '회신: ' || coalesce(answer, '') ELSE coalesce(body, '') END END AS embed_text
FROM ({_TYPED})""")
def embed_text_switch(spark, d):
    """The text that stands for a record of each type."""
    names = ("record_type", "text", "term", "question", "answer", "body", "facts", "violation", "basis")
    return _typed(spark, d).select("doc_id", T.embed_text(*map(F.col, names)).alias("embed_text"))


@query(f"""SELECT doc_id, 'c' || doc_id % 3 AS collection, '' AS doc_no, coalesce(record_type, '') AS record_type, nullif(term, '') AS term, nullif(array_to_string([facts, violation], ' | '), '') AS attachments,
CASE WHEN record_type = 'audit_case' THEN nullif(basis, '') END AS standard, CASE WHEN record_type = 'audit_case' THEN doc_id % 3 = 1 END AS superseded FROM ({_TYPED})""")
def metadata_project(spark, d):
    """Flat metadata: empty values as null, lists joined, base fields never null, audit fields of audit cases only."""
    records = _typed(spark, d).select("doc_id", "record_type", "term", F.array("facts", "violation").alias("attachments"), F.col("basis").alias("standard"), (F.col("doc_id") % 3 == 1).alias("standard_superseded"))
    m = R.metadata(records, F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")))
    return records.select("doc_id", m.alias("m")).select("doc_id", "m.collection", "m.doc_no", "m.record_type", "m.term", "m.attachments", "m.standard", F.col("m.standard_superseded").alias("superseded"))


@query(f"""SELECT doc_id, substr(coalesce(text, ''), 1, 40) AS clipped, coalesce(nullif(term, ''), nullif(question, ''), CAST(doc_id AS VARCHAR)) AS display_id FROM ({_TYPED})""")
def clip_and_display_id(spark, d):
    """A prefix of the text, and the first name that is not empty."""
    return _typed(spark, d).select("doc_id", T.clip(F.col("text"), 40).alias("clipped"), T.display_id(F.col("term"), F.col("question"), F.col("doc_id").cast("string")).alias("display_id"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_anti(spark, d):
    """Documents whose id is not in the loaded table yet."""
    return R.only_new(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("""WITH u AS (SELECT o_custkey AS id, o_orderkey AS version, o_totalprice AS price FROM orders)
SELECT id, version, price FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""")
def upsert_latest(spark, d):
    """The latest version of each id after a second load."""
    o = table(spark, d, "orders").selectExpr("o_custkey as id", "o_orderkey as version", "o_totalprice as price")
    return R.upsert(o.where("version % 2 = 0"), o.where("version % 2 = 1"))


_STATS = "SELECT source AS board, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'body_fallback' WHEN 2 THEN 'attachment(hwp)' ELSE 'html' END AS qa_source, CASE WHEN doc_id % 3 = 0 THEN concat(source, '-', doc_id) ELSE concat('2025-', doc_id) END AS doc_no, doc_id % 4 AS nrefs FROM documents"


@query(f"""SELECT board, count(*) AS n, count(*) FILTER (coalesce(qa_source, 'html') = 'html') AS html, count(*) FILTER (qa_source = 'body_fallback') AS fallback,
 round(count(*) FILTER (qa_source = 'body_fallback') / count(*), 9) AS fallback_ratio, count(*) FILTER (NOT starts_with(doc_no, board || '-')) AS official, count(*) FILTER (nrefs = 0) AS no_refs FROM ({_STATS}) GROUP BY board""")
def board_stats(spark, d):
    """Counts per board."""
    table(spark, d, "documents").createOrReplaceTempView("documents_")
    r = spark.sql(_STATS.replace("FROM documents", "FROM documents_")).withColumn("standard_refs", F.array_repeat(F.lit("r"), F.col("nrefs").cast("int")))
    return R.board_stats(r).withColumn("fallback_ratio", F.round("fallback_ratio", 9))


@query("""WITH r AS (SELECT source AS board, doc_id AS seq, count(*) OVER w AS n, sum(CASE WHEN doc_id % 17 IN (1, 5, 7, 11, 16) THEN 1 ELSE 0 END) OVER w AS f
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT board, min(seq) FILTER (n >= 20 AND f / n > 0.3) AS tripped_at FROM r GROUP BY board""")
def fallback_guard(spark, d):
    """Where a board's share of fallbacks passes the limit."""
    r = table(spark, d, "documents").select(F.col("source").alias("board"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 17).isin(1, 5, 7, 11, 16).alias("fallback"))
    return R.guard(r)


@query("""WITH RECURSIVE s AS (
  SELECT doc_id, lang, least(greatest(length(coalesce(text, '')) // 2, 1), 8192) AS tok FROM documents
), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tok DESC, doc_id) AS rn FROM s),
b AS (
  SELECT lang, CAST(1 AS BIGINT) AS first, CAST(0 AS BIGINT) AS batch, greatest(1, least(32, 8192 // tok)) AS size FROM o WHERE rn = 1
  UNION ALL
  SELECT b.lang, b.first + b.size, b.batch + 1, greatest(1, least(32, 8192 // o.tok)) FROM b JOIN o ON o.lang = b.lang AND o.rn = b.first + b.size
)
SELECT doc_id AS id, o.lang AS grp, CAST(tok AS BIGINT) AS tokens, batch FROM o JOIN b ON b.lang = o.lang AND rn >= first AND rn < first + size""")
def adaptive_batches(spark, d):
    """Texts in batches that fit a token budget."""
    return R.adaptive_batches(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), "lang")


@query("""SELECT event_type AS node, count(*) AS n, CAST(sum(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT)) AS BIGINT) AS prompt, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS completion FROM events GROUP BY 1""")
def token_totals(spark, d):
    """Prompt and completion totals per node, read from JSON."""
    k = F.get_json_object(T.json_object(F.col("props")), "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("n"), F.sum(k).alias("prompt"), F.sum(F.floor("value").cast("long")).alias("completion"))


@query("""SELECT CAST(toxic AS INT) AS toxic, count(*) AS n, round(avg(CASE WHEN doc_id % 9 <> 0 THEN least(1.0, greatest(0.0, CAST(quality * 1.5 - (doc_id % 4) * 0.25 AS DOUBLE))) END), 6) AS mean_score FROM labels GROUP BY 1""")
def judge_clamp_avg(spark, d):
    """The mean of judged scores held to 0 to 1; missing ones do not count."""
    raw = F.when(F.col("doc_id") % 9 != 0, F.col("quality") * 1.5 - (F.col("doc_id") % 4) * 0.25)
    return table(spark, d, "labels").groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n"), F.round(F.avg(judged(raw)), 6).alias("mean_score"))


@query("SELECT event_type AS node, count(*) AS n, CAST(floor(avg(CAST(floor(value) AS BIGINT))) AS BIGINT) AS mean_ms FROM events WHERE event_id % 11 <> 0 GROUP BY 1")
def trace_latency(spark, d):
    """Mean latency per node over nested traces, one per user; events without a latency do not count."""
    node = F.struct(F.col("event_type").alias("node"), F.when(F.col("event_id") % 11 != 0, F.floor("value").cast("long")).alias("latency_ms"))
    return R.latency_by_node(table(spark, d, "events").groupBy("user_id").agg(F.collect_list(node).alias("trace")))


_RAW = "CASE event_id % 5 WHEN 0 THEN concat('ok ', props, ' end') WHEN 1 THEN concat(props, ' and ', props) WHEN 2 THEN 'none' WHEN 3 THEN '{}' ELSE props END"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '{{}}' ELSE props END AS json FROM events")
def json_extract(spark, d):
    """The JSON object in an answer, if what stands between its outer braces is one."""
    return table(spark, d, "events").select("event_id", T.json_object(F.expr(_RAW)).alias("json"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 5 IN (1, 2, 3)) / greatest(count(*), 1) AS broken FROM events GROUP BY 1")
def json_broken_rate(spark, d):
    """The share of answers without a usable object; an empty one is not usable."""
    j = T.json_object(F.expr(_RAW))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count_if(j.isNull() | (j == "{}")) / F.greatest(F.count("*"), F.lit(1))).alias("broken"))


@query("""WITH t AS (SELECT event_id AS seq, concat('q', user_id) AS question, CASE WHEN event_id % 4 = 0 THEN 'old' END AS eval FROM events),
e AS (SELECT DISTINCT concat('q', user_id) AS question, unnest(CASE WHEN user_id % 3 = 0 THEN ['new1', 'new2'] ELSE ['new1'] END) AS eval FROM events WHERE user_id % 2 = 0),
o AS (SELECT seq, question, row_number() OVER (PARTITION BY question ORDER BY seq DESC) AS n FROM t WHERE eval IS NULL),
m AS (SELECT question, eval, row_number() OVER (PARTITION BY question ORDER BY eval) AS n FROM e)
SELECT t.seq, t.question, coalesce(t.eval, m.eval) AS eval FROM t LEFT JOIN o ON o.seq = t.seq LEFT JOIN m ON m.question = o.question AND m.n = o.n""")
def trace_eval_merge(spark, d):
    """Evaluations, two of some questions, go to the last trace rows of their question that have none."""
    question = F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question")
    t = table(spark, d, "events").select(F.col("event_id").alias("seq"), question, F.when(F.col("event_id") % 4 == 0, "old").alias("eval"))
    new = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("new1"), F.lit("new2"))).otherwise(F.array(F.lit("new1")))
    e = table(spark, d, "events").where("user_id % 2 = 0").select(question, F.explode(new).alias("eval")).distinct()
    return R.attach_eval(t, e)


def _joined_history(rows):
    h = F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["content"], F.lit(""))))
    return rows.select(F.col("thread").alias("conv_id"), F.col("seq").alias("turn"), F.array_join(h, "|").alias("history"))


_HISTORY = """SELECT conv_id, turn, coalesce(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history
FROM conversations WHERE role IN ('user', 'assistant')"""


@query(_HISTORY)
def history_last6(spark, d):
    """The six messages before each one."""
    m = table(spark, d, "conversations").where("role in ('user', 'assistant')").select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return _joined_history(R.history(m))


@query(_HISTORY)
def history_stream(spark, d):
    """The same from a stream that keeps the last messages of each thread as state."""
    rows = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")  # a pattern may be one file or a folder
    rows = rows.where("role in ('user', 'assistant')")
    m = rows.select(F.col("conv_id").cast("string").alias("thread"), F.col("turn").cast("long").alias("seq"), "role", F.col("text").alias("content"))
    at = shared_folder(spark, "history")
    C.thread_history(m).writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return _joined_history(spark.read.schema(C.HISTORY).parquet(f"{at}/rows").withColumn("thread", F.col("thread").cast("long")))


@query("""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, CASE WHEN role = 'user' AND coalesce(lag(role) OVER w, '') <> 'user' THEN 1 ELSE 0 END AS b
  FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM m)
SELECT conv_id, min(turn) AS turn, string_agg(t, chr(10) ORDER BY turn) FILTER (role = 'user') AS question, string_agg(t, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS answer, count(*) AS messages FROM g GROUP BY conv_id, g""")
def conversation_exchanges(spark, d):
    """Conversations cut into exchanges by a table function over a table."""
    X.register(spark)
    table(spark, d, "conversations").createOrReplaceTempView("conversations_")
    return spark.sql("SELECT * FROM exchanges(TABLE(conversations_), 'conv_id', 'turn', 'role', 'text')")


@query("""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS t FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS pos, h[i] AS href, trim(regexp_replace(t[i], '<[^>]*>', '', 'g')) AS text FROM p, unnest(range(1, len(h) + 1)) u(i)""")
def pages_links(spark, d):
    """Links of each page with their texts."""
    return table(spark, d, "pages").select("page_id", F.posexplode(H.links(F.col("html"))).alias("pos", "x")).select("page_id", "pos", "x.href", "x.text")


@query("SELECT page_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(concat(html, '<a onclick=\"G_MovePage(', page_id % 13, ')\">'), 'G_MovePage\\((\\d+)\\)', 1), lambda x: CAST(x AS INT))), 1) AS INT) AS last_page FROM pages")
def page_count(spark, d):
    """The last page that a list links to."""
    p = F.concat("html", F.lit('<a onclick="G_MovePage('), (F.col("page_id") % 13).cast("string"), F.lit(')">'))
    return table(spark, d, "pages").select("page_id", H.last_page(p).alias("last_page"))


@query()
def pages_text(spark, d):
    """Pages as text, one line per block and per table row."""
    return table(spark, d, "pages").select("page_id", H.html_text(F.col("html")).alias("text"))




@query("SELECT CAST(page_id AS VARCHAR) AS seq, 'Title ' || page_id AS title, '2025-01-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') AS reply_date, '' AS open_date FROM pages WHERE page_id % 4 <> 0")
def pages_list_rows(spark, d):
    """Rows of a board's list pages without other boards' pinned rows."""
    quote = F.lit("'")
    board = F.when(F.col("page_id") % 4 == 0, "016009").otherwise("016005")
    no = F.col("page_id").cast("string")
    call = F.concat(F.lit("fn_Detail("), quote, no, quote, F.lit(","), quote, board, quote, F.lit(")"))
    row = F.concat(
        F.lit("<table><tr><td>"), no, F.lit('</td><td><a href="#" onclick="'), call, F.lit('">Title <b>'), no, F.lit("</b></a></td><td></td><td>2025-01-"),
        F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"), F.lit("</td></tr></table>"),
    )
    return H.list_rows(table(spark, d, "pages").select(row.alias("html")), "016005")


def _pieces():
    """The lines and sentences of a whole document."""
    return F.split(F.coalesce("text", F.lit("")), r"\n|(?<=[.!?。])(?=\s)")


def _standard(spark, d, lines):
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"), (1001 + F.col("doc_id") % 120).cast("string").alias("number"))


def _standard_texts(spark, d):
    """Whole documents as standards: a heading, then each piece in turn as a numbered paragraph, two sub-items and a line that goes on."""
    before = ("표지", "용어의 정의", "1 이 기준서는 다음을 다룬다.", "⑴ 첫째", "⑵ 둘째", "12개월 동안", "1A 덧붙인 문단", "B1 부록 문단", "9 Westferry Circus")

    def line(x, i):
        no = F.concat((2 + F.floor(i / 3600)).cast("string"), F.lit("."), (1 + F.floor(i / 4) % 900).cast("string"))
        start = F.when(i % 4 == 0, F.concat(no, F.lit(" 이 문단은 "))).when(i % 4 == 1, "⑴ ").when(i % 4 == 2, "⑵ ").otherwise("또한 ")
        return F.concat(start, x)

    return _standard(spark, d, F.concat(F.array(*map(F.lit, before)), F.transform(_pieces(), line), F.array(F.lit("적용사례"), F.lit("BC1 끝 문단"))))


#: Longer than a term may be, so a colon after it begins no term.
_GOES_ON = "앞의 용어에 덧붙이는 설명이며 새로운 용어를 정하지 아니하는 줄이다 그 내용은 "


def _term_texts(spark, d):
    """Whole documents as a list of terms: each piece in turn as two definitions and a line that goes on."""
    before = ("표지", "용어의 정의", "적용사례", "1 용어의 정의는 다음과 같다.")
    line = lambda x, i: F.concat(F.when(i % 3 == 2, _GOES_ON).otherwise(F.concat(F.lit("용어 "), i.cast("string"), F.lit(": 뜻 "))), x)
    return _standard(spark, d, F.concat(F.array(*map(F.lit, before)), F.transform(_pieces(), line), F.array(F.lit("2 끝 문단"))))


@query()
def split_paragraphs(spark, d):
    """Paragraphs and sub-items of standards."""
    return S.split_documents(_standard_texts(spark, d), "standard")


@query()
def split_paragraph_lines(spark, d):
    """The same from numbered lines, a document's over many tasks."""
    return L.split_lines(L.lines_of(_standard_texts(spark, d)), in_order=True)


@query()
def split_terms(spark, d):
    """Terms of standards."""
    return S.split_documents(_term_texts(spark, d), "terms")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN lang || ' asks' END AS question, CASE WHEN doc_id % 3 <> 2 THEN 'reply ' || doc_id END AS answer, CASE WHEN doc_id % 3 = 1 THEN source END AS related FROM documents""")
def split_qa(spark, d):
    """Question, answer and related part by their markers, after the whole document; nothing without an answer's marker."""
    t = F.concat(
        F.lit("머리말\n"), F.coalesce("text", F.lit("")), F.lit("\n[질 의]\n"), "lang", F.lit(" asks\n"), F.when(F.col("doc_id") % 3 != 2, F.concat(F.lit("[회신]\nreply "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("판단근거\n"), "source")).otherwise(F.lit("")),
    )
    docs = table(spark, d, "documents").select("doc_id", t.alias("text"), F.lit("").alias("number"))
    return S.split_documents(docs, "qa").select("doc_id", "question", "answer", "related")


_SQUEEZE = "regexp_replace({0}, '[ \\t\\n\\r]+', '', 'g')"


@query(f"""WITH b AS (SELECT item_id AS tid, {_SQUEEZE.format('text')} AS x FROM benchmark), d AS (SELECT doc_id AS page_no, {_SQUEEZE.format('text')} AS body FROM documents),
n AS (SELECT tid, CASE len WHEN 40 THEN 0 WHEN 24 THEN 1 ELSE 2 END AS pos, substr(x, 1, len) AS needle FROM b, (SELECT unnest([40, 24, 12]) AS len)),
h AS (SELECT tid, pos, page_no, row_number() OVER (PARTITION BY tid ORDER BY pos, page_no) AS r FROM n JOIN d ON contains(body, needle) WHERE length(needle) >= 8)
SELECT b.tid, h.page_no FROM b LEFT JOIN h ON h.tid = b.tid AND r = 1""")
def substring_page_match(spark, d):
    """The first document that holds the beginning of a benchmark item."""
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("tid"), F.lit("").alias("term"), "text")
    return page_of(terms, table(spark, d, "documents").select(F.col("doc_id").alias("page_no"), "text"))
