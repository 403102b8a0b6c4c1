"""Rank fusion, lexical scope and padding, quota, metrics, neighbours."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import joins, metrics
from folioscope.operators import retrieval as R
from folioscope.operators.containment import page_of
from folioscope.operators.scorers import scorer


def test_rrf_scores_and_order(spark):
    rows = [(1, 0, 10, 1), (1, 0, 11, 2), (1, 0, 12, 3), (1, 1, 11, 1), (1, 1, 13, 2)]
    got = R.rrf(spark.createDataFrame(rows, "qid long, list_no int, id long, rank int")).orderBy("rank").collect()
    assert [r.id for r in got] == [11, 10, 13, 12]
    assert [r.score for r in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62, 1 / 63])


def test_bm25_scope_and_padding(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "x y"), (4, "z"), (5, None)], "id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "nothing")], "qid long, qtext string")
    got = {r.qid: r.ids for r in R.bm25_topk(q, docs, 3).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids")).collect()}
    assert got[1][:2] == [2, 1] and got[2] == [1, 2, 3]
    scope = spark.createDataFrame([(1, 1), (1, 3)], "qid long, id long")
    assert [r.id for r in R.bm25_topk(q.where("qid = 1"), docs, 3, scope=scope).orderBy("rank").collect()] == [1, 3]


def quota(items, routing, k):
    """Plain rule: each absent standards collection overwrites the lowest slot without standards."""
    top, rest = list(items[:k]), items[k:]
    taken = [i for i in range(len(top) - 1, -1, -1) if not top[i][1].endswith("standards")]
    for c in routing:
        if c.endswith("standards") and all(x[1] != c for x in items[:k]):
            new = next((x for x in rest if x[1] == c), None)
            if new and taken:
                top[taken.pop(0)] = new
    return top


def test_quota_follows_the_plain_rule(spark):
    r = random.Random(3)
    colls = ["qa_a", "qa_b", "a_standards", "b_standards", "c_standards"]
    ranked, routing, want = [], [], {}
    for q in range(60):
        items = [(q * 100 + i, r.choice(colls[: r.randint(1, 5)] if i < 6 else colls)) for i in range(r.randint(1, 14))]
        order = r.sample(colls, 5)
        ranked += [(q, i, c, n) for n, (i, c) in enumerate(items, 1)]
        routing += [(q, c, n, c.endswith("standards")) for n, c in enumerate(order)]
        want[q] = [i for i, _ in quota(items, order, 4)]
    out = R.with_quota(spark.createDataFrame(ranked, "qid long, id long, collection string, rank int"), spark.createDataFrame(routing, "qid long, collection string, pos int, standards boolean"), 4)
    got = {}
    for x in out.orderBy("qid", "slot").collect():
        got.setdefault(x.qid, []).append(x.id)
    assert got == want


def test_routed_search_runs_both_ways(spark):
    docs = spark.createDataFrame([(i, "qa" if i % 2 else "x_standards", [float(i % 5), 1.0], f"word{i} common") for i in range(12)], "id long, collection string, vec array<float>, text string")
    q = spark.createDataFrame([(1, [1.0, 1.0], "word3 common")], "qid long, qvec array<float>, qtext string")
    routing = spark.createDataFrame([(1, "qa", 0, False), (1, "x_standards", 1, True)], "qid long, collection string, pos int, standards boolean")
    for bm25 in (True, False):
        out = R.routed_search(q, docs, routing, scorer("overlap"), k=3, per_coll=3, use_bm25=bm25).orderBy("slot").collect()
        assert [r.slot for r in out] == [1, 2, 3] and "x_standards" in {r.collection for r in out}


def test_neighbors(spark):
    k = spark.createDataFrame([(1, "제1109호 문단 B45"), (2, "제1109호 문단 45")], "qid long, ref_key string")
    corpus = spark.createDataFrame([(f"제1109호 문단 {x}",) for x in ("B44", "B45", "B46", "45", "47")], ["ref_key"])
    got = {}
    for r in joins.with_neighbors(k, corpus).collect():
        got.setdefault(r.qid, set()).add(r.ref_key)
    assert got == {1: {f"제1109호 문단 B{n}" for n in (44, 45, 46)}, 2: {"제1109호 문단 45"}}


def test_scores_without_expected_keys_are_zero(spark):
    df = spark.createDataFrame([([], ["제1001호 문단 1"]), (["제1001호 문단 1", "제1001호 문단 5"], ["제1001호 문단 1", "제1001호 문단 4"])], "e array<string>, g array<string>")
    a, b = (r.m.asDict() for r in df.select(metrics.scores(metrics.parsed(F.col("e")), metrics.parsed(F.col("g")), 5).alias("m")).collect())
    assert set(a.values()) == {0}
    assert b == {"exact": 0.5, "capped": 0.5, "relaxed": 0.75, "ho": 1.0, "hit": 1.0, "precision": 0.2, "nhit": 1}


def test_page_of_prefers_earlier_needles(spark):
    t = spark.createDataFrame([(1, "term", "definition of it goes on"), (2, "", "short"), (3, None, "nowhere to be found")], "tid long, term string, text string")
    p = spark.createDataFrame([(1, "a definition of it goes on"), (2, "b term\n definition of it goes on"), (3, "")], "page_no long, text string")
    assert {r.tid: r.page_no for r in page_of(t, p).collect()} == {1: 2, 2: None, 3: None}


def test_looked_up_in_order(spark):
    rec = spark.createDataFrame([(0, 0, None, "D1", "by number"), (1, 0, "K", "D2", "by key"), (0, 1, "K2", "D1", "later")], "coll_pos int, lineno long, ref_key string, doc_no string, text string")
    ans = spark.createDataFrame([(1, ["K", "none", "D1"]), (2, [])], "rid long, used_refs array<string>")
    got = {r.rid: [(v.ref, v.text) for v in r.verified] for r in joins.looked_up_in_order(ans, rec).collect()}
    assert got == {1: [("K", "by key"), ("D1", "by number")], 2: []}
