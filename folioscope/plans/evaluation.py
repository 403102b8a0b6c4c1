"""Goldens, neighbours and retrieval metrics over keys synthesised from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as M
from ..operators import records as R
from .citations import _extracted, _STD, _TERM, _CH, _texts
from .registry import query, table

_BOARD = "CASE {0} % 4 WHEN 0 THEN '016001' WHEN 1 THEN '016002' WHEN 2 THEN '016003' ELSE '016005' END"

# Targets: what a part's record offers to be cited.
_TARGETS = """SELECT p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN concat('제', 1001 + p_partkey % 60, '호 문단 ', 1 + p_partkey % 7) WHEN 1 THEN concat('제', 1001 + p_partkey % 60, '호') END AS ref_key,
 CASE WHEN p_partkey % 3 = 2 THEN concat('제', 1001 + p_partkey % 60, '호 용어의 정의') END AS section_key,
 CASE WHEN p_partkey % 7 = 0 THEN 'kgaap_standards' ELSE 'kifrs_standards' END AS collection FROM part"""

_GOLDEN = f"""{_extracted(_STD, _TERM, _CH)}, tg AS ({_TARGETS}),
q AS (SELECT l_orderkey * 10 + l_linenumber AS id, {_BOARD.format('l_orderkey')} AS board, CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE t END AS question, refs FROM ext),
rk AS (SELECT ref_key AS ref, arg_min(collection, pos) AS coll FROM tg WHERE ref_key IS NOT NULL GROUP BY 1),
sk AS (SELECT section_key AS ref, arg_min(collection, pos) AS coll FROM tg WHERE section_key IS NOT NULL GROUP BY 1),
e AS (SELECT id, nth, refs[nth] AS ref FROM q, unnest(range(1, len(refs) + 1)) u(nth)),
h AS (SELECT e.*, coalesce(rk.coll, sk.coll) AS coll FROM e LEFT JOIN rk USING (ref) LEFT JOIN sk USING (ref)),
g AS (SELECT id, string_agg(ref, '|' ORDER BY nth) AS ks, list_sort(list(DISTINCT coll)) AS cs, count(*) AS n FROM h WHERE coll IS NOT NULL GROUP BY id),
golden AS (SELECT q.id, board, CASE WHEN question = '' THEN 'no_question' WHEN g.id IS NULL THEN 'no_joinable_ref' END AS reason,
  coalesce(ks, '') AS ks, coalesce(array_to_string(cs, '|'), '') AS cs, coalesce(n, 0) AS n FROM q LEFT JOIN g USING (id))"""


def _goldens(spark, d):
    from ..functions.refs import extract_refs

    board = F.expr(_BOARD.format("l_orderkey"))
    q = _texts(spark, d).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), board.alias("board"),
        F.when(F.col("l_orderkey") % 13 == 0, "").otherwise(F.col("t")).alias("question"), extract_refs(F.col("t")).alias("refs"),
    )
    table(spark, d, "part").createOrReplaceTempView("part_")
    return R.golden_rows(q, spark.sql(_TARGETS.replace("FROM part", "FROM part_")))


@query(f"WITH {_GOLDEN} SELECT id, board, ks AS expected_ref_keys, cs AS expected_collections FROM golden WHERE reason IS NULL")
def golden_build(spark, d):
    """Questions with the keys and collections that their citations lead to."""
    g = _goldens(spark, d).where("reason is null")
    return g.select("id", "board", F.array_join("expected_ref_keys", "|").alias("expected_ref_keys"), F.array_join("expected_collections", "|").alias("expected_collections"))


@query(f"WITH {_GOLDEN} SELECT board, coalesce(reason, 'kept') AS reason, count(*) AS n FROM golden GROUP BY 1, 2")
def golden_skip_reasons(spark, d):
    """Kept and skipped questions per board, by reason."""
    return _goldens(spark, d).groupBy("board", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_GOLDEN} SELECT board, round(avg(n), 6) AS mean_refs, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_refs, CAST(max(n) AS BIGINT) AS max_refs FROM golden WHERE reason IS NULL GROUP BY board")
def golden_ref_stats(spark, d):
    """Mean, median and maximum of the number of expected keys."""
    n = F.size("expected_ref_keys")
    return _goldens(spark, d).where("reason is null").groupBy("board").agg(
        F.round(F.avg(n), 6).alias("mean_refs"), F.floor(F.percentile(n, 0.5)).cast("long").alias("median_refs"), F.max(n).cast("long").alias("max_refs")
    )


_TEMPLATES = ("What is {term}?", "Define {term}.", "How is {term} defined?")


# Every fifth part is a standard's record, whose key names no term.
_TERMS = "p_partkey, p_name AS term, CASE WHEN p_partkey % 5 = 0 THEN concat('S', p_brand) ELSE concat('S:', p_brand, ':', lpad(cast(p_partkey as varchar(20)), 9, '0')) END AS ref_key, 'S' AS section_key"


@query(f"""WITH t AS (SELECT {_TERMS} FROM part)
SELECT p_partkey, replace(CASE (row_number() OVER (ORDER BY ref_key) - 1) % 3 WHEN 0 THEN 'What is {{term}}?' WHEN 1 THEN 'Define {{term}}.' ELSE 'How is {{term}} defined?' END, '{{term}}', term) AS question
FROM t WHERE section_key IS NOT NULL AND contains(ref_key, ':') AND length(term) >= 2""")
def definition_golden_cycle(spark, d):
    """A question per term, templates in turn; records without a term in their key have none."""
    table(spark, d, "part").createOrReplaceTempView("part_")
    return R.definition_goldens(spark.sql(f"SELECT {_TERMS} FROM part_"), _TEMPLATES).select("p_partkey", "question")


_KEY = "concat('제', 1001 + l_orderkey % 40, '호 문단 ', CASE WHEN l_orderkey % 3 = 0 THEN 'B' ELSE '' END, l_linenumber + l_orderkey % 7)"
_PART_KEY = "concat('제', 1001 + p_partkey % 40, '호 문단 ', CASE WHEN p_partkey % 3 = 0 THEN 'B' ELSE '' END, 1 + p_partkey % 11)"
_NK = f"k AS (SELECT DISTINCT l_orderkey AS qid, {_KEY} AS ref_key FROM lineitem), corpus AS (SELECT DISTINCT {_PART_KEY} AS ref_key FROM part)"
_P = "regexp_extract({0}, '^(제\\d+[호장])', 1) AS {1}ho, regexp_extract({0}, '문단 (\\D*)(\\d+)$', 1) AS {1}pre, CAST(regexp_extract({0}, '문단 (\\D*)(\\d+)$', 2) AS BIGINT) AS {1}n"


@query(f"""WITH {_NK}, p AS (SELECT qid, ref_key, {_P.format('ref_key', '')} FROM k),
n AS (SELECT qid, ho || ' 문단 ' || pre || (n + s) AS ref_key FROM p, (SELECT unnest([-1, 1]) AS s))
SELECT qid, ref_key FROM k UNION SELECT qid, ref_key FROM n WHERE ref_key IN (SELECT ref_key FROM corpus)""")
def neighbor_expand(spark, d):
    """Every order's keys with the neighbours that the parts have."""
    keys = table(spark, d, "lineitem").selectExpr("l_orderkey as qid", f"{_KEY} as ref_key")
    return J.with_neighbors(keys, table(spark, d, "part").selectExpr(f"{_PART_KEY} as ref_key"))


@query(f"""WITH p AS (SELECT ref_key, {_P.format('ref_key', '')} FROM (SELECT DISTINCT {_KEY} AS ref_key FROM lineitem))
SELECT a.ref_key AS a, b.ref_key AS b FROM p a JOIN p b ON a.ho = b.ho AND a.pre = b.pre AND b.n = a.n + 1""")
def adjacent_pairs(spark, d):
    """Neighbouring keys, each pair once."""
    return J.adjacent_pairs(table(spark, d, "lineitem").selectExpr(f"{_KEY} as ref_key"))


# A golden per order with up to four expected keys; hits are line items of the next orders.
_IR_GOLD = f"SELECT o_orderkey AS qid, {_BOARD.format('o_orderkey')} AS board, 1001 + o_orderkey % 40 AS no, o_orderkey % 5 AS n FROM orders"
_IR_HITS = """SELECT o_orderkey AS qid, r AS rank, concat('제', 1001 + (o_orderkey + CASE WHEN r % 3 = 0 THEN r ELSE 0 END) % 40, '호 문단 ', 1 + (o_orderkey * 3 + r * 5) % 11) AS ref_key,
 CASE WHEN r % 4 = 0 THEN concat('제', 1001 + o_orderkey % 40, '호 용어의 정의') END AS section_key FROM orders, rr"""
_IR = f"""rr AS (SELECT unnest(range(1, 14)) AS r), gold AS ({_IR_GOLD}), hits AS ({_IR_HITS}), ks AS (SELECT unnest([5, 10]) AS k),
ex AS (SELECT DISTINCT qid, CASE j WHEN 4 THEN concat('제', no, '호 용어의 정의') ELSE concat('제', no, '호 문단 ', 1 + (qid + j * 2) % 11) END AS e FROM gold, (SELECT unnest(range(1, 5)) AS j) WHERE j <= n),
got AS (SELECT DISTINCT qid, k, key FROM (SELECT qid, k, unnest([ref_key, section_key]) AS key FROM hits, ks WHERE rank <= k) WHERE key IS NOT NULL),
p AS (SELECT *, regexp_extract(key, '^(제\\d+호)', 1) AS ho, TRY_CAST(regexp_extract(key, '문단 (\\d+)$', 1) AS BIGINT) AS pn FROM got),
x AS (SELECT ex.*, k, regexp_extract(e, '^(제\\d+호)', 1) AS ho, TRY_CAST(regexp_extract(e, '문단 (\\d+)$', 1) AS BIGINT) AS pn,
  EXISTS (SELECT 1 FROM got g WHERE g.qid = ex.qid AND g.k = ks.k AND g.key = e) AS found FROM ex, ks),
y AS (SELECT x.*, NOT found AND EXISTS (SELECT 1 FROM p WHERE p.qid = x.qid AND p.k = x.k AND p.ho = x.ho AND abs(p.pn - x.pn) = 1) AS near,
  EXISTS (SELECT 1 FROM p WHERE p.qid = x.qid AND p.k = x.k AND p.ho = x.ho) AS ho_found FROM x),
a AS (SELECT qid, k, count(*) AS n, count(*) FILTER (found) AS nhit, count(*) FILTER (near) AS nnear, count(DISTINCT ho) AS nho, count(DISTINCT ho) FILTER (ho_found) AS hho FROM y GROUP BY qid, k),
m AS (SELECT g.qid, g.board, ks.k, coalesce(nhit / b.n, 0) AS exact, coalesce(nhit / least(b.n, ks.k), 0) AS capped, coalesce((nhit + 0.5 * nnear) / b.n, 0) AS relaxed, coalesce(hho / nho, 0) AS ho,
  CASE WHEN nhit > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(nhit, 0) / ks.k AS "precision", coalesce(nhit, 0) AS nhit FROM gold g CROSS JOIN ks LEFT JOIN (SELECT qid, k, a.n, nhit, nnear, nho, hho FROM a) b ON b.qid = g.qid AND b.k = ks.k)"""


def _measured(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_")
    ranks = "(SELECT explode(sequence(1, 13)) AS r)"
    gold = spark.sql(_IR_GOLD.replace("FROM orders", "FROM orders_"))
    j = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda j: j <= F.col("n"))
    para = lambda j: F.concat(F.lit("제"), F.col("no").cast("string"), F.lit("호 문단 "), (1 + (F.col("qid") + j * 2) % 11).cast("string"))
    keys = F.transform(j, lambda j: F.when(j == 4, F.concat(F.lit("제"), F.col("no").cast("string"), F.lit("호 용어의 정의"))).otherwise(para(j)))
    gold = gold.withColumn("expected", F.array_distinct(keys))
    hits = spark.sql(_IR_HITS.replace("FROM orders, rr", f"FROM orders_ CROSS JOIN {ranks}"))
    return M.evaluate(gold, hits)


@query(f"""WITH {_IR} SELECT qid, board, CAST(k AS INT) AS k, round(exact, 6) AS exact, round(capped, 6) AS capped, round(relaxed, 6) AS relaxed, round(ho, 6) AS ho, CAST(hit AS DOUBLE) AS hit, round("precision", 6) AS "precision", nhit FROM m""")
def ir_metrics_at_k(spark, d):
    """Every metric of every question at 5 and 10."""
    return _measured(spark, d).select("qid", "board", "k", *(F.round(m, 6).alias(m) for m in M.METRICS), "nhit")


@query(f"""WITH {_IR}, s AS (SELECT k, unnest([board, 'ALL']) AS scope, exact, capped, relaxed, ho, hit, "precision" FROM m)
SELECT CAST(k AS INT) AS k, scope, count(*) AS n, round(avg(exact), 9) AS exact, round(avg(capped), 9) AS capped, round(avg(relaxed), 9) AS relaxed, round(avg(ho), 9) AS ho, round(avg(CAST(hit AS DOUBLE)), 9) AS hit,
  round(avg("precision"), 9) AS "precision" FROM s GROUP BY k, scope""")
def ir_metrics_rollup(spark, d):
    """Means per board and over all."""
    return M.summarize(_measured(spark, d), digits=9)


@query(f"""WITH {_IR} SELECT qid, round(max(capped) FILTER (k = 5), 6) AS at5, round(max(capped) FILTER (k = 10), 6) AS at10 FROM m GROUP BY qid""")
def capped_recall(spark, d):
    """Recall against what k hits can reach."""
    at = lambda k: F.round(F.max(F.when(F.col("k") == k, F.col("capped"))), 6).alias(f"at{k}")
    return _measured(spark, d).groupBy("qid").agg(at(5), at(10))
