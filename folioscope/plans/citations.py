"""Citation queries over texts synthesised from lineitem, since the tables hold no citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs as C
from ..functions import routing, text as T
from ..functions.nfkc import nfkc_key
from ..operators import answering as A
from ..operators import joins as J
from ..operators.shared import saved
from .registry import query, table

# One text per line item, the same expression in both engines; it takes every branch of the grammar in turn.
CITING = """CASE l_orderkey % 12
 WHEN 0 THEN concat('제', 1001 + l_orderkey % 120, '호 문단 ', l_linenumber, '~', l_linenumber + l_orderkey % 7, '를 참조')
 WHEN 1 THEN concat('제', 1001 + l_orderkey % 120, '호 ‘리스  ', l_linenumber, '’에 따라 처리')
 WHEN 2 THEN concat('이는 제', 1001 + l_orderkey % 120, '호이다')
 WHEN 3 THEN concat('제', 1001 + l_orderkey % 120, '호 문단 B', l_linenumber, ', 문단 BC', l_orderkey % 40, ', 문단 7⑴을 적용')
 WHEN 4 THEN concat('제', 1001 + l_orderkey % 120, '호 문단 1~200')
 WHEN 5 THEN concat('제', 1001 + l_orderkey % 120, '호 문단 ', l_linenumber + 5, '~', l_linenumber)
 WHEN 6 THEN concat('제0', 1 + l_orderkey % 9, '장 문단 ', l_linenumber, '~', l_linenumber + 2)
 WHEN 7 THEN concat('제', 10 + l_orderkey % 9, '장 “유형자산” 문단 ', 10 + l_orderkey % 9, '.', l_linenumber)
 WHEN 8 THEN concat('IFRS ', 1 + l_orderkey % 17, ' 문단 ', l_linenumber, ' 및 IAS ', 1 + l_orderkey % 41, ' 참조')
 WHEN 9 THEN concat('(제', 1001 + l_orderkey % 120, '호 용어의 정의)와 제', 1002 + l_orderkey % 120, '호')
 WHEN 10 THEN concat('제', 1001 + l_orderkey % 120, '호의 관련 문단 4.1.', l_linenumber, 'A와 문단 9')
 ELSE concat('K-IFRS ', l_linenumber, '와 제', 1 + l_orderkey % 30, '장') END"""

_BASE = f"SELECT l_orderkey, l_linenumber, {CITING} AS t FROM lineitem"
_NORMAL = f"translate(t, '{C.QUOTES_FROM}', '{C.QUOTES_TO.replace(chr(39), chr(39) * 2)}')"
_PARA = C.PARA
_SQ = lambda s: "'" + s.replace("'", "''") + "'"


def _all(pattern: str, g: int) -> str:
    return f"list_transform(regexp_extract_all(s, {_SQ(pattern.replace('(?U)', ''))}, {g}), lambda x: coalesce(x, ''))"


def _expand(p: str, q: str) -> str:
    """SQL for the labels of a range from p to q."""
    part = lambda x, i: f"regexp_extract({x}, '^(.*?)(\\d+)(\\D*)$', {i})"
    n = lambda x: f"CAST({part(x, 2)} AS BIGINT)"
    fits = f"{part(p, 1)} = {part(q, 1)} AND {part(p, 3)} = {part(q, 3)} AND {n(p)} <= {n(q)} AND {n(q)} - {n(p)} < 50"
    return f"CASE WHEN {fits} THEN list_transform(range({n(p)}, {n(q)} + 1), lambda k: {part(p, 1)} || k || {part(p, 3)}) ELSE [{p}, {q}] END"


def _keys_sql(kind: str) -> str:
    """SQL for the keys of all matches of one kind ('호' or '장') in s."""
    pattern = C.STANDARD if kind == "호" else C.CHAPTER
    no = "g1[i]" if kind == "호" else "CAST(CAST(g1[i] AS INT) AS VARCHAR)"
    label = "p" if kind == "호" else f"CASE WHEN regexp_matches(p, '^\\d+(?:[A-Z]|[⑴-⒇])*$') AND NOT starts_with(p, {no} || '.') THEN {no} || '.' || p ELSE p END"
    last = f"regexp_extract(g4[i], '^\\s*[~∼]\\s*({_PARA})', 1)"
    paras = f"list_concat([g3[i]], CASE WHEN {last} <> '' THEN {_expand('g3[i]', last)} ELSE [] END, regexp_extract_all(g4[i], '[,，]\\s*문단\\s*({_PARA})', 1))"
    name = "trim(regexp_replace(g2[i], '\\s+', ' ', 'g'))"
    each = f"""list_concat(
      CASE WHEN g2[i] <> '' THEN ['제' || {no} || '{kind} ''' || {name} || ''''] ELSE [] END,
      CASE WHEN g3[i] <> '' THEN list_transform({paras}, lambda p: '제' || {no} || '{kind} 문단 ' || {label}) ELSE [] END,
      CASE WHEN g2[i] = '' AND g3[i] = '' THEN ['제' || {no} || '{kind}'] ELSE [] END)"""
    groups = ", ".join(f"{_all(pattern, g)} AS g{g}" for g in range(1, 5))
    return f"(SELECT flatten(list_transform(range(1, len(g1) + 1), lambda i: {each})) FROM (SELECT {groups}))"


def _distinct(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


_STD, _CH = _keys_sql("호"), _keys_sql("장")
_TERM = f"list_transform({_all(C.TERM_SECTION, 1)}, lambda x: '제' || x || '호 용어의 정의')"


def _extracted(*parts: str, keep: str = "") -> str:
    return f"""base AS ({_BASE}), norm AS (SELECT *, {_NORMAL} AS s FROM base),
    raw AS (SELECT *, list_concat({", ".join(parts)}) AS a FROM norm), ext AS (SELECT *, {_distinct("a")} AS refs FROM raw {keep})"""


def _texts(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CITING).alias("t"))


@query(f"WITH base AS ({_BASE}) SELECT l_orderkey, l_linenumber, {_NORMAL} AS s FROM base")
def ref_normalize(spark, d):
    """Quotation marks and wide blanks in one form."""
    return _texts(spark, d).select("l_orderkey", "l_linenumber", C.normalize_ref(F.col("t")).alias("s"))


_OF = "array_to_string(list_filter(refs, lambda x: {0}regexp_matches(x, '^제\\d+장')), '|') AS refs"


@query(f"WITH {_extracted(_STD, _TERM, _CH)} SELECT l_orderkey, l_linenumber, {_OF.format('NOT ')} FROM ext")
def ref_extract_std(spark, d):
    """The keys of standards in every text, none in many."""
    keys = F.filter(C.extract_refs(F.col("t")), lambda x: ~x.rlike(r"^제\d+장"))
    return _texts(spark, d).select("l_orderkey", "l_linenumber", F.array_join(keys, "|").alias("refs"))


@query(f"WITH {_extracted(_STD, _TERM, _CH)} SELECT l_orderkey, l_linenumber, {_OF.format('')} FROM ext")
def ref_extract_kgaap(spark, d):
    """The keys of chapters in every text, none in most."""
    keys = F.filter(C.extract_refs(F.col("t")), lambda x: x.rlike(r"^제\d+장"))
    return _texts(spark, d).select("l_orderkey", "l_linenumber", F.array_join(keys, "|").alias("refs"))


# RE2 has no look-behind: the character before is captured instead, and the word end is ASCII there as it is in these texts.
_INTL = r"(?:^|[^-\w가-힣])(IFRS|IAS|IFRIC|SIC)\s*(\d{1,2})(?: |$)(?:[^\n]{0,15}?문단\s*(" + _PARA + "))?"


@query(f"""WITH base AS ({_BASE}), g AS (
  SELECT l_orderkey, l_linenumber, {_all(_INTL, 1)} AS k, {_all(_INTL, 2)} AS n, {_all(_INTL, 3)} AS p FROM (SELECT *, t AS s FROM base)
), r AS (
  SELECT l_orderkey, l_linenumber, list_transform(range(1, len(k) + 1), lambda i: '제' || CASE k[i] WHEN 'IFRS' THEN '11' WHEN 'IAS' THEN '10' WHEN 'IFRIC' THEN '21' ELSE '20' END
    || lpad(CAST(CAST(n[i] AS INT) AS VARCHAR), 2, '0') || '호' || CASE WHEN p[i] <> '' THEN ' 문단 ' || p[i] ELSE '' END) AS a FROM g
) SELECT l_orderkey, l_linenumber, array_to_string({_distinct("a")}, '|') AS refs FROM r""")
def ref_extract_intl(spark, d):
    """Citations in international notation under national numbers."""
    return _texts(spark, d).select("l_orderkey", "l_linenumber", F.array_join(C.extract_international(F.col("t")), "|").alias("refs"))


_ENDS = "concat(substr('XBCAG', 1 + l_orderkey % 3, l_orderkey % 3), l_linenumber) AS a, concat(substr('XBCAG', 1 + l_orderkey % 3, l_orderkey % 3), greatest(l_linenumber + l_orderkey % 70 - 5, 0)) AS b"


@query(f"WITH e AS (SELECT l_orderkey, l_linenumber, {_ENDS} FROM lineitem) SELECT l_orderkey, l_linenumber, array_to_string({_expand('a', 'b')}, '|') AS labels FROM e")
def ref_range_expand(spark, d):
    """Ranges of labels: ascending, reversed and too wide ones."""
    e = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_ENDS.split(", concat(")[:1], "concat(" + _ENDS.split(", concat(")[1])
    return e.select("l_orderkey", "l_linenumber", F.array_join(C.expand_range(F.col("a"), F.col("b")), "|").alias("labels"))


_KIND = """CASE WHEN regexp_matches(ref, '^제\\d{1,2}장') THEN CASE WHEN contains(ref, '문단') THEN '장문단' WHEN contains(ref, '''') THEN '장제목' ELSE '단독장' END
 WHEN regexp_matches(ref, '^제\\d{3,4}호') THEN CASE WHEN ends_with(ref, '용어의 정의') THEN '용어섹션' WHEN contains(ref, '문단') THEN '문단' WHEN contains(ref, '''') THEN '제목' ELSE '단독호' END
 ELSE '기타' END"""


def _cited(spark, d):
    t = _texts(spark, d)
    return t.select("l_orderkey", "l_linenumber", F.posexplode(C.extract_refs(F.col("t"))).alias("pos", "ref"))


@query(f"WITH {_extracted(_STD, _TERM, _CH)}, c AS (SELECT unnest(refs) AS ref FROM ext) SELECT {_KIND} AS kind, count(*) AS n FROM c GROUP BY 1")
def ref_classify(spark, d):
    """Citations by kind."""
    return _cited(spark, d).groupBy(C.kind_of(F.col("ref")).alias("kind")).agg(F.count("*").alias("n"))


# Paragraph records: what a part's key makes of a standard's, a term section's or a chapter's record.
_RECORDS = """SELECT p_partkey,
 CASE p_partkey % 4 WHEN 0 THEN concat('제', 1001 + p_partkey % 60, '호 문단 ', 1 + p_partkey % 7) WHEN 1 THEN concat('제', 1 + p_partkey % 9, '장 문단 ', 1 + p_partkey % 9, '.', 1 + p_partkey % 7)
   WHEN 2 THEN concat('제', 1001 + p_partkey % 60, '호 문단 B', 1 + p_partkey % 7) ELSE NULL END AS ref_key,
 CASE WHEN p_partkey % 4 = 3 THEN concat('제', 1001 + p_partkey % 60, '호 용어의 정의') END AS section_key,
 CASE WHEN p_partkey % 4 <> 1 THEN concat('', 1001 + p_partkey % 60) END AS standard_no,
 CASE WHEN p_partkey % 4 = 1 THEN concat('', 1 + p_partkey % 9) END AS chapter_no, p_partkey % 3 AS coll_pos, concat('D', p_partkey % 50) AS doc_no, p_name AS text FROM part"""
_HITS = f"""{_extracted(_STD, _TERM, _CH)}, rec AS ({_RECORDS}),
c AS (SELECT l_orderkey, l_linenumber, pos - 1 AS pos, refs[pos] AS ref FROM ext, unnest(range(1, len(refs) + 1)) u(pos)),
k AS (SELECT *, {_KIND} AS kind, regexp_extract(ref, '^제(\\d+)[호장]', 1) AS no FROM c),
h AS (SELECT *, CASE WHEN kind IN ('문단', '장문단') THEN ref IN (SELECT ref_key FROM rec WHERE ref_key IS NOT NULL)
  WHEN kind = '용어섹션' THEN ref IN (SELECT section_key FROM rec WHERE section_key IS NOT NULL)
  WHEN kind IN ('제목', '단독호') THEN no IN (SELECT standard_no FROM rec WHERE standard_no IS NOT NULL)
  WHEN kind IN ('장제목', '단독장') THEN no IN (SELECT chapter_no FROM rec WHERE chapter_no IS NOT NULL) ELSE false END AS hit FROM k)"""


def _record_rows(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part_")
    return spark.sql(_RECORDS.replace("FROM part", "FROM part_"))


@query(f"""WITH {_HITS}, s AS (SELECT unnest(list_filter(['all', CASE WHEN kind IN ('문단', '장문단', '용어섹션') THEN 'precise' END, kind], lambda x: x IS NOT NULL)) AS scope, hit FROM h)
SELECT scope, count(*) AS n, CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS hits FROM s GROUP BY scope""")
def ref_join_report(spark, d):
    """How many citations lead to a record, by kind, for precise ones, and for all."""
    return J.join_report(J.citation_hits(_cited(spark, d), _record_rows(spark, d)))


@query(f"WITH {_HITS}, h2 AS (SELECT * FROM h) SELECT l_orderkey, l_linenumber, pos FROM h2 WHERE hit AND l_orderkey % 5 = 0")
def join_regression_diff(spark, d):
    """Citations that led to a record before and, with a fifth of the texts lost, do not any more."""
    # citations are taken out of the texts once: places that hit are saved for both sides
    hits = saved(J.citation_hits(_cited(spark, d), _record_rows(spark, d)).where("hit").select("l_orderkey", "l_linenumber", "pos", "hit"))
    lost = hits.withColumn("hit", F.col("hit") & (F.col("l_orderkey") % 5 != 0))
    return J.regression(hits, lost, "l_orderkey", "l_linenumber", "pos").select("l_orderkey", "l_linenumber", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH rec AS ({_RECORDS}), q AS (
  SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 2 = 0 THEN concat('제', 1001 + o_orderkey % 60, '호 문단 ', 1 + o_orderkey % 7) ELSE concat('D', o_orderkey % 70) END AS ref FROM orders
), m AS (
  SELECT rid, ref, p_partkey, row_number() OVER (PARTITION BY rid, ref ORDER BY coll_pos, CASE WHEN ref_key = ref THEN 0 ELSE 1 END, p_partkey) AS n
  FROM q JOIN rec ON ref_key = ref OR doc_no = ref
) SELECT rid, ref, p_partkey FROM m WHERE n = 1""")
def ref_lookup_first_match(spark, d):
    """The record of a citation: by collection, then by key before document number, then by file order."""
    q = table(spark, d, "orders").selectExpr("o_orderkey as rid", "CASE WHEN o_orderkey % 2 = 0 THEN concat('제', 1001 + o_orderkey % 60, '호 문단 ', 1 + o_orderkey % 7) ELSE concat('D', o_orderkey % 70) END AS ref")
    return J.lookup(q, _record_rows(spark, d).withColumn("lineno", F.col("p_partkey"))).select("rid", "ref", "p_partkey")


@query()
def nfkc_normalize(spark, d):
    """Keys in one compatibility form without blanks."""
    return _cited(spark, d).select("l_orderkey", "l_linenumber", nfkc_key(F.col("ref")).alias("key"))


# Answers: texts of conversations with brackets put into them.
_ANSWER = "concat(coalesce(text, ''), ' [제', 1000 + conv_id % 50, '호] 및  [D', turn % 3, ']', CASE WHEN turn % 4 = 1 THEN ' [D9]' ELSE '' END, CASE WHEN conv_id % 9 = 0 THEN ' 근거를 찾지 못함' ELSE '' END)"
_VALID = "array('D0', 'D1', '제1001호', '제1003호', '제1005호')"
_VALID_SQL = "['D0', 'D1', '제1001호', '제1003호', '제1005호']"
_ANS = f"a AS (SELECT conv_id, turn, {_ANSWER} AS t, {_VALID_SQL} AS valid FROM conversations), c AS (SELECT *, regexp_extract_all(t, '\\[([^\\[\\]]+)\\]', 1) AS cites FROM a)"


def _answers(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_ANSWER} as t", f"{_VALID} as valid")


@query(f"WITH {_ANS} SELECT conv_id, turn, array_to_string(cites, '|') AS cites FROM c")
def citation_extract(spark, d):
    """What stands in brackets."""
    return _answers(spark, d).select("conv_id", "turn", F.array_join(T.citations(F.col("t")), "|").alias("cites"))


_BAD = "list_filter(list_filter(cites, lambda x, i: list_position(cites, x) = i), lambda x: NOT list_contains(valid, x))"
_REFUSED = "(contains(t, '근거를 찾지 못') OR length(t) < 15)"


@query(f"WITH {_ANS} SELECT conv_id, turn, array_to_string({_BAD}, '|') AS invalid, NOT {_REFUSED} AND len({_BAD}) > 0 AS retry FROM c")
def citation_invalid(spark, d):
    """Citations of what was not retrieved, and whether the answer is asked for again."""
    t, v = F.col("t"), F.col("valid")
    return _answers(spark, d).select("conv_id", "turn", F.array_join(T.invalid_citations(t, v), "|").alias("invalid"), T.needs_citation_retry(t, v).alias("retry"))


_STRIPPED = f"regexp_replace(regexp_replace(list_reduce({_BAD}, lambda acc, x: replace(acc, '[' || x || ']', ''), t), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"WITH {_ANS} SELECT conv_id, turn, {_STRIPPED} AS text FROM c")
def citation_strip(spark, d):
    """Answers without their invalid citations."""
    return _answers(spark, d).select("conv_id", "turn", T.strip_citations(F.col("t"), T.invalid_citations(F.col("t"), F.col("valid"))).alias("text"))


_USED = "list_filter(list_filter(cites, lambda x, i: list_position(cites, x) = i), lambda x: list_contains(valid, x))"


@query(f"""WITH {_ANS}, u AS (SELECT *, {_USED} AS used, {_REFUSED} AS refused FROM c)
SELECT conv_id, turn, NOT refused AND len(used) > 0 AS strict, CASE WHEN NOT refused AND len(used) > 0 THEN array_to_string(used, '|') ELSE '' END AS strict_refs,
       NOT refused AS lenient, array_to_string(used, '|') AS lenient_refs, CASE WHEN refused THEN '-' ELSE {_STRIPPED} END AS lenient_text FROM u""")
def used_refs_gate(spark, d):
    """Grounds and used references of an answer under the strict and the lenient rule."""
    a = _answers(spark, d)
    s, n = (T.answer_gate(F.col("t"), F.col("valid"), strict, F.lit("-")) for strict in (True, False))
    a = a.select("conv_id", "turn", s.alias("s"), n.alias("n"))
    return a.select(
        "conv_id", "turn", F.col("s.has_grounds").alias("strict"), F.array_join("s.used_refs", "|").alias("strict_refs"),
        F.col("n.has_grounds").alias("lenient"), F.array_join("n.used_refs", "|").alias("lenient_refs"), F.col("n.text").alias("lenient_text"),
    )


_AGAIN = f"CASE WHEN NOT {_REFUSED} AND len({_BAD}) > 0 THEN '다시: [D1] [D9] ' || t ELSE t END"


@query(f"""WITH a AS (SELECT conv_id, turn, regexp_replace({_ANSWER}, '^\\s+|\\s+$', '', 'g') AS t, {_VALID_SQL} AS valid FROM conversations),
c AS (SELECT *, regexp_extract_all(t, '\\[([^\\[\\]]+)\\]', 1) AS cites FROM a),
b AS (SELECT conv_id, turn, valid, {_AGAIN} AS t FROM c), e AS (SELECT *, regexp_extract_all(t, '\\[([^\\[\\]]+)\\]', 1) AS cites FROM b)
SELECT conv_id, turn, {_STRIPPED} AS said FROM e""")
def answer_second_attempt(spark, d):
    """Answers with invalid citations are asked for once more; what is invalid then is stripped."""
    rows = _answers(spark, d).select("conv_id", "turn", F.col("t").alias("question"), F.col("valid").alias("refs"), F.lit("근거").alias("evidence"))
    model = lambda q, e: F.when(e.contains(A.CITATION_NOTE.split("%s")[0]), F.concat(F.lit("다시: [D1] [D9] "), T.strip(q))).otherwise(q)
    return A.answered(rows, model).select("conv_id", "turn", "said")


_PROMPTS = "'근거:' || chr(10) || substr(coalesce(text, ''), 1, 6000) || chr(10) || chr(10) || '답변:' || chr(10) || coalesce(text, '') AS pf, '질문: ' || role || chr(10) || chr(10) || '답변:' || chr(10) || coalesce(text, '') AS pr"
# an output is broken if the prompt's length and the attempt sum to a multiple of 3, or in both attempts for multiples of 7
_BROKEN = "(length({0}) % 7 = 0 OR (length({0}) % 3 = 0 AND (length({0}) + 1) % 3 = 0))"
_SCORE = "CASE WHEN NOT {b} THEN CAST(least(length({p}) % 4, 1) AS DOUBLE) END"


@query(f"""WITH p AS (SELECT conv_id, turn, {_PROMPTS} FROM conversations),
s AS (SELECT conv_id, turn, {_SCORE.format(b=_BROKEN.format('pf'), p='pf')} AS f, {_SCORE.format(b=_BROKEN.format('pr'), p='pr')} AS r FROM p)
SELECT conv_id, turn, f AS faithfulness, CASE WHEN f IS NOT NULL THEN 'a|b' WHEN r IS NOT NULL THEN '' END AS unsupported, r AS relevancy, CASE WHEN r IS NOT NULL THEN 'why' WHEN f IS NOT NULL THEN '' END AS reason FROM s""")
def judge_plan(spark, d):
    """Two scores per answer by a judge whose outputs are broken now and then."""
    c = table(spark, d, "conversations")
    body = F.coalesce("text", F.lit(""))
    trace = c.select("conv_id", "turn", F.col("role").alias("question"), body.alias("answer"), body.alias("grounding"), F.lit(None).cast(A.EVAL).alias("eval"))

    def judge(kind, prompt, attempt):
        n = F.length(prompt)
        good = F.concat(F.lit('so: {"score": '), (n % 4).cast("string"), F.lit(', "unsupported": ["a", "b"], "reason": "why"}'))
        return F.when(((n + attempt) % 3 == 0) | (n % 7 == 0), "no object").otherwise(good)

    out = A.judge_answers(trace, judge, "v", "m")
    return out.select("conv_id", "turn", "eval.faithfulness", F.array_join("eval.unsupported", "|").alias("unsupported"), F.col("eval.answer_relevancy").alias("relevancy"), F.col("eval.relevancy_reason").alias("reason"))


# Questions and what a router asked for.
_QUESTION = "concat(CASE o_orderkey % 5 WHEN 0 THEN '중소기업의 ' WHEN 1 THEN '상장법인의 ' WHEN 2 THEN '비상장 회사의 ' WHEN 3 THEN 'KIFRS와 일반기업 ' ELSE '' END, '회계처리 ', o_orderkey)"
_ASKED = "CASE o_orderkey % 4 WHEN 0 THEN {a}'qa_kifrs', 'kgaap_standards'{z} WHEN 1 THEN {a}'kifrs_standards'{z} WHEN 2 THEN {a}'kgaap_standards', 'qa_kgaap'{z} ELSE {a}'other'{z} END"
_QTYPE = "CASE o_orderkey % 3 WHEN 0 THEN '정의조회' WHEN 1 THEN '사례시나리오' END"
_ROUTE = f"""q AS (SELECT o_orderkey, {_QUESTION} AS question, {_ASKED.format(a='[', z=']')} AS asked, {_QTYPE} AS qtype FROM orders),
k AS (SELECT *, list_filter(asked, lambda c: list_contains(['qa_kifrs', 'qa_kgaap', 'kifrs_standards', 'kgaap_standards'], c)) AS kept,
  regexp_matches(question, '중소기업|일반기업|비상장|중견기업') AS g, regexp_matches(question, '상장|연결재무제표|K-?IFRS|국제회계|지배기업') AS i FROM q),
f AS (SELECT *, CASE WHEN g AND NOT i THEN CASE WHEN len(list_filter(kept, lambda c: contains(c, 'kgaap'))) > 0 THEN list_filter(kept, lambda c: contains(c, 'kgaap')) ELSE ['qa_kgaap', 'kgaap_standards'] END
  WHEN i AND NOT g THEN CASE WHEN len(list_filter(kept, lambda c: contains(c, 'kifrs'))) > 0 THEN list_filter(kept, lambda c: contains(c, 'kifrs')) ELSE ['qa_kifrs', 'kifrs_standards'] END
  ELSE list_concat(kept, list_filter(['qa_kifrs', 'qa_kgaap', 'kifrs_standards', 'kgaap_standards'], lambda c: NOT list_contains(kept, c))) END AS guarded FROM k)"""


def _asked(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_QUESTION} as question", f"{_ASKED.format(a='array(', z=')')} as asked", f"{_QTYPE} as qtype")


@query(f"WITH {_ROUTE} SELECT o_orderkey, array_to_string(guarded, '|') AS collections FROM f")
def framework_guard(spark, d):
    """Collections by the framework that a question names."""
    kept = F.filter("asked", lambda c: F.array_contains(F.array(*map(F.lit, routing.COLLECTIONS)), c))
    return _asked(spark, d).select("o_orderkey", F.array_join(routing.framework_guard(F.col("question"), kept), "|").alias("collections"))


@query(f"""WITH {_ROUTE}, s AS (SELECT *, CASE WHEN qtype = '정의조회' AND len(list_filter(guarded, lambda c: ends_with(c, 'standards'))) = 0 THEN list_append(guarded, 'kifrs_standards') ELSE guarded END AS d FROM f)
SELECT o_orderkey, array_to_string(CASE WHEN qtype = '사례시나리오' THEN list_concat(list_filter(d, lambda c: starts_with(c, 'qa_')), list_filter(d, lambda c: NOT starts_with(c, 'qa_'))) ELSE d END, '|') AS collections FROM s""")
def route_order(spark, d):
    """Guarded collections in the order of the question's kind."""
    return _asked(spark, d).select("o_orderkey", F.array_join(routing.route(F.col("question"), F.col("asked"), F.col("qtype")), "|").alias("collections"))
