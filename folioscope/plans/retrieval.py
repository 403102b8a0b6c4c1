"""Retrieval queries. Collections are labels of embeddings or languages of documents; questions are benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import retry_needed
from ..operators import dense_index, lexical_index
from ..operators import retrieval as R
from ..operators.answering import retrieved_again
from ..operators.metrics import without_own
from ..operators.scorers import scorer
from ..operators.shared import shared_folder
from .registry import query, table

# Queries of vector search: every vector whose id is divisible by 50.
_SIM = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (
  SELECT q.vec_id AS qid, v.vec_id AS id, v.label,
         list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS sim
  FROM v q JOIN v ON q.vec_id % 50 = 0
)"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return q, e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("collection"), F.col("embedding").alias("vec"))


@query(f"""WITH {_SIM}, r AS (
  SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY round(sim, 9) DESC, id) AS rank FROM sims)
SELECT qid, CAST(label AS VARCHAR) AS collection, id, rank FROM r WHERE rank <= 5""")
def dense_topk_per_label(spark, d):
    """The 5 nearest vectors of each label for each query vector."""
    return R.dense_topk(*_vectors(spark, d), k=5).select("qid", "collection", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims)
SELECT qid, id, rank, round(sim, 6) AS sim FROM r WHERE rank <= 20""")
def dense_global_topk(spark, d):
    """The 20 nearest vectors of all labels."""
    return R.dense_topk(*_vectors(spark, d), k=20, per_collection=False).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


def _index(spark, d):
    q, c = _vectors(spark, d)
    return q, dense_index.build_index(c, shared_folder(spark, "dense-index"))


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims)
SELECT qid, id, rank, round(sim, 6) AS sim FROM r WHERE rank <= 20""")
def dense_index_topk(spark, d):
    """The 20 nearest vectors of all labels, read from the cells of an inverted file that can hold them."""
    r = dense_index.index_topk(*_index(spark, d), k=20, exact=True)
    return r.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@query()
def dense_index_probed(spark, d):
    """20 near vectors out of as few cells as hold 0.95 of the 20 nearest for rows of the corpus; some of the nearest may be missed."""
    q, index = _index(spark, d)
    r = dense_index.index_topk(q, index, k=20, probes=dense_index.probes_for(_vectors(spark, d)[1], index, 20))
    return r.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[^ \t\n\r.,;:!?()]+')"


def _bm25(where: str = "") -> str:
    return f"""
w AS (SELECT doc_id AS id, lang, {_TOKENS.format('text')} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, s),
m AS (SELECT avg(idf) AS mean_idf FROM idf),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT id, lang, dl, term, count(*) AS tf FROM (SELECT id, lang, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
sc AS (
  SELECT qid, id, lang, round(sum(CASE WHEN idf < 0 THEN mean_idf * 0.25 ELSE idf END * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM tf JOIN q USING (term) JOIN idf USING (term), s, m {where} GROUP BY qid, id, lang
)"""


def _texts(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    return q, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text")


@query(f"""WITH {_bm25()}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)
SELECT qid, id, rank, round(score, 4) AS score FROM r WHERE rank <= 10""")
def bm25_topk(spark, d):
    """The 10 best documents of each question by BM25."""
    return R.bm25_topk(*_texts(spark, d), k=10).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(f"""WITH {_bm25()}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)
SELECT qid, id, rank, round(score, 4) AS score FROM r WHERE rank <= 10""")
def postings_topk(spark, d):
    """The 10 best documents of each question by BM25, out of a stored index."""
    q, docs = _texts(spark, d)
    index = lexical_index.build_postings(docs.select("id", "text"), shared_folder(spark, "postings"))
    r = lexical_index.postings_topk(q, index, 10)
    return r.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(f"""WITH {_bm25()}, scoped AS (
  SELECT b.item_id AS qid, d.doc_id AS id, coalesce(score, 0) AS score
  FROM benchmark b JOIN documents d ON d.lang = CASE b.item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END
  LEFT JOIN sc ON sc.qid = b.item_id AND sc.id = d.doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scoped)
SELECT qid, id, rank FROM r WHERE rank <= 10""")
def bm25_scoped_topk(spark, d):
    """The 10 best of one language's documents; statistics stay those of all."""
    q, docs = _texts(spark, d)
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("qid") % 4 + 1).cast("int"))
    return R.bm25_topk(q.withColumn("within", F.array(lang)), docs.withColumnRenamed("lang", "within"), k=10).select("qid", "id", F.col("rank").cast("long").alias("rank"))


_LISTS = """
lists AS (
  SELECT qid, 0 AS list_no, id, rank FROM dense WHERE rank <= 20
  UNION ALL SELECT qid, 1, id, rank FROM other WHERE rank <= 20
), f AS (
  SELECT qid, id, sum(1.0 / (60 + rank)) AS score, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY qid, id
), fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM f)"""


@query(f"""WITH {_SIM}, dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims),
half AS (SELECT vec_id, e[1:32] AS e FROM v),
hsims AS (SELECT q.vec_id AS qid, h.vec_id AS id, list_dot_product(q.e, h.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(h.e, h.e)) AS sim FROM half q JOIN half h ON q.vec_id % 50 = 0),
other AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM hsims), {_LISTS}
SELECT qid, id, rank, round(score, 9) AS score FROM fused WHERE rank <= 30""")
def rrf_fuse(spark, d):
    """Lists by the whole vectors and by their first halves, fused by reciprocal ranks."""
    q, c = _vectors(spark, d)
    half_q, half_c = q.withColumn("qvec", F.slice("qvec", 1, 32)), c.withColumn("vec", F.slice("vec", 1, 32))
    lists = [R.dense_topk(x, y, 20, per_collection=False).select("qid", "id", "rank", F.lit(i).alias("list_no")) for i, (x, y) in enumerate(((q, c), (half_q, half_c)))]
    return R.rrf(lists[0].unionByName(lists[1]), keep=30).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


_HYBRID_DENSE = """
qv AS (SELECT b.item_id AS qid, b.text AS qtext, CAST(e.embedding AS DOUBLE[]) AS qe FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
cv AS (SELECT doc_id AS id, lang, text, CAST(e.embedding AS DOUBLE[]) AS e FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id),
hs AS (SELECT qid, id, lang, list_dot_product(qe, e) / sqrt(list_dot_product(qe, qe)) / sqrt(list_dot_product(e, e)) AS sim FROM qv, cv WHERE e IS NOT NULL),
hl AS (SELECT *, row_number() OVER (PARTITION BY qid, lang ORDER BY round(sim, 9) DESC, id) AS r FROM hs),
dense AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM hl WHERE r <= 20)"""


def _hybrid_inputs(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), "text")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("qtext")).join(e, "id")
    return q.select(F.col("id").alias("qid"), "qtext", F.col("vec").alias("qvec")), docs, e


@query(f"""WITH {_HYBRID_DENSE},
{_bm25().lstrip()},
other AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc),
lists AS (
  SELECT qid, 0 AS list_no, id, rank FROM dense UNION ALL SELECT qid, 1, id, rank FROM other WHERE rank <= 20
), f AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY qid, id),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM f),
t AS (
  SELECT fused.qid, fused.id, cv.lang,
         len(list_intersect(list_distinct({_TOKENS.format('qtext')}), list_distinct({_TOKENS.format('text')}))) / greatest(len(list_distinct({_TOKENS.format('qtext')})), 1) AS s
  FROM fused JOIN qv USING (qid) JOIN cv USING (id) WHERE rank <= 30
), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM t)
SELECT qid, rank, id, lang AS collection, round(s, 6) AS score FROM r WHERE rank <= 5""")
def hybrid_search(spark, d):
    """Dense and lexical candidates, the dense ones of documents that have a vector, fused, then reranked by token overlap; the first 5."""
    q, corpus, vectors = _hybrid_inputs(spark, d)
    out = R.search(q, corpus, scorer("overlap"), per_coll=20, rerank_n=30, k=5, vectors=vectors)
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "id", "collection", F.round("score", 6).alias("score"))


@query(f"""WITH {_SIM}, ranked AS (
  SELECT qid, id, label, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims
), top AS (SELECT * FROM ranked WHERE rank <= 8),
best AS (SELECT qid, label, arg_min(id, rank) AS new_id FROM ranked WHERE rank > 8 AND label >= 7 GROUP BY qid, label),
absent AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.qid ORDER BY label) AS i FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.qid = b.qid AND t.label = b.label)
), loose AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank DESC) AS i FROM top WHERE label < 7)
SELECT t.qid, t.rank AS slot, coalesce(a.new_id, t.id) AS id, CAST(coalesce(a.label, t.label) AS VARCHAR) AS collection
FROM top t LEFT JOIN loose l ON l.qid = t.qid AND l.rank = t.rank LEFT JOIN absent a ON a.qid = l.qid AND a.i = l.i""")
def quota_retrieve(spark, d):
    """The first 8 with labels 7 to 9 as standards collections that must be present."""
    q, c = _vectors(spark, d)
    # the k best overall and the best of each label hold everything that can be chosen
    near = R.dense_topk(q, c, 9)
    ranked = near.withColumn("rank", F.row_number().over(R.Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 9)), "id"))).select("qid", "id", "collection", "rank")
    routing = q.select("qid", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("pos"))
    routing = routing.select("qid", F.col("pos").cast("string").alias("collection"), "pos", (F.col("pos") >= 7).alias("standards"))
    return R.with_quota(ranked, routing, 8).select("qid", F.col("slot").cast("long").alias("slot"), "id", "collection")


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims),
l AS (SELECT * FROM r WHERE rank <= 50)
SELECT q.vec_id AS qid, (q.vec_id * 3 + 1) % 500 AS target, (SELECT min(rank) FROM l WHERE l.qid = q.vec_id AND l.id = (q.vec_id * 3 + 1) % 500) AS rank
FROM v q WHERE q.vec_id % 50 = 0""")
def rank_of_target(spark, d):
    """Where a target stands among the 50 nearest, if it does."""
    q, c = _vectors(spark, d)
    ranked = R.dense_topk(q, c, 50, per_collection=False)
    targets = q.select("qid", ((F.col("qid") * 3 + 1) % 500).alias("target"))
    return R.rank_of(ranked, targets).select("qid", "target", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims)
SELECT qid, bool_or(id = qid AND rank <= 3) AS own_hit, bool_or(rank <= 5 AND contains(CAST(id AS VARCHAR), '7')) AS prefix_hit FROM r GROUP BY qid""")
def hit_prefix_topk(spark, d):
    """Whether a query finds itself in its first 3, and a key that contains a string in its first 5."""
    r = R.dense_topk(*_vectors(spark, d), 5, per_collection=False)
    return r.groupBy("qid").agg(F.bool_or((F.col("id") == F.col("qid")) & (F.col("rank") <= 3)).alias("own_hit"), F.bool_or(F.contains(F.col("id").cast("string"), F.lit("7"))).alias("prefix_hit"))


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM r WHERE id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 10""")
def self_leak_exclude(spark, d):
    """A query's own row goes before its list is cut to 10."""
    r = R.dense_topk(*_vectors(spark, d), 11, per_collection=False)
    kept = without_own(r.withColumns({"doc_no": F.col("id"), "own_doc": F.col("qid")})).where("rank <= 10")
    return kept.select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SIM} SELECT qid, id FROM sims WHERE coalesce(sim, 0) >= 0.3""")
def score_threshold(spark, d):
    """Candidates at or above a similarity."""
    return R.dense_above(*_vectors(spark, d), 0.3).select("qid", "id")


@query(f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims WHERE id <> qid),
t AS (SELECT q.vec_id AS qid, (SELECT sim FROM r WHERE r.qid = q.vec_id AND rank = 1) AS top FROM v q WHERE q.vec_id % 50 = 0)
SELECT qid, NOT (qid % 100 = 0) AND coalesce(top, 0) < 0.45 AS retry FROM t""")
def retry_predicate(spark, d):
    """Whether a question is asked again in other words: the first score is low and that has not been done."""
    r = without_own(R.dense_topk(*_vectors(spark, d), 2, per_collection=False).withColumns({"doc_no": F.col("id"), "own_doc": F.col("qid")}))
    top = r.where("rank = 1").groupBy("qid").agg(F.collect_list("sim").alias("s"))
    return top.select("qid", retry_needed(F.col("s"), F.col("qid") % 100 == 0, 0.45).alias("retry"))


@query(f"""WITH {_SIM},
other AS (SELECT v.vec_id AS qid, w.e FROM v JOIN v w ON w.vec_id = v.vec_id + 1 WHERE v.vec_id % 50 = 0),
osims AS (SELECT o.qid, v.vec_id AS id, list_dot_product(o.e, v.e) / sqrt(list_dot_product(o.e, o.e)) / sqrt(list_dot_product(v.e, v.e)) AS sim FROM other o JOIN v ON v.vec_id <> o.qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM sims WHERE id <> qid),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM osims),
low AS (SELECT q.vec_id AS qid FROM v q LEFT JOIN r ON r.qid = q.vec_id AND r.rank = 1 WHERE q.vec_id % 50 = 0 AND q.vec_id % 100 <> 0 AND coalesce(r.sim, 0) < 0.45)
SELECT qid, rank AS slot, id, round(sim, 6) AS score, 0 AS pass FROM r WHERE rank <= 8 AND qid NOT IN (SELECT qid FROM low)
UNION ALL SELECT qid, rank, id, round(sim, 6), 1 FROM o WHERE rank <= 8 AND qid IN (SELECT qid FROM low)""")
def second_retrieval(spark, d):
    """The 8 nearest other vectors; where the first is not near, those of a rewriting, for which the next vector stands in."""
    q, c = _vectors(spark, d)
    asked = q.withColumn("retried", F.col("qid") % 100 == 0)

    def retrieve(asked):
        r = R.dense_topk(asked.select("qid", "qvec"), c, 9, per_collection=False)
        own = without_own(r.withColumns({"doc_no": F.col("id"), "own_doc": F.col("qid")}))
        return own.where("rank <= 8").select("qid", F.col("rank").cast("long").alias("slot"), "id", F.col("sim").alias("score"))

    def again(low):
        return low.drop("qvec").join(c.select((F.col("id") - 1).alias("qid"), F.col("vec").alias("qvec")), "qid")

    return retrieved_again(asked, retrieve, again, threshold=0.45).select("qid", "slot", "id", F.round("score", 6).alias("score"), "pass")
