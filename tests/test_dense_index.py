"""The inverted file against a search of all vectors: equal when exact, near enough when probed, and cells left unread."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import dense_index as D
from folioscope.operators import retrieval as R
from folioscope.operators.shared import shared_folder

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    return e.where("vec_id % 50 = 0").selectExpr("vec_id as qid", "embedding as qvec"), e.selectExpr("vec_id as id", "cast(label as string) as collection", "embedding as vec")


def keys(df):
    return {(r.qid, r["rank"], r.id, r.collection, round(r.sim, 8)) for r in df.collect()}


def test_recall_of_probed_cells(spark, vectors):
    q, c = vectors
    index = D.build_index(c, shared_folder(spark, "t"))
    probes = D.probes_for(c, index, 20)
    want = {(r.qid, r.id) for r in R.dense_topk(q, c, 20, per_collection=False).collect()}
    got = {(r.qid, r.id) for r in D.index_topk(q, index, 20, probes=probes).collect()}
    recall, share = len(want & got) / len(want), D.cells_read(index, probes)
    print(f"recall@20 {recall:.3f} reading {share:.2f} of {len(index.angles)} cells")
    assert recall >= 0.9 and share < 1


def test_exact_search_equals_all_vectors(spark, vectors):
    q, c = vectors
    index = D.open_index(spark, D.build_index(c, shared_folder(spark, "t"), cells=9).folder)
    for k, probes in ((1, 1), (20, 1), (700, 2)):
        assert keys(D.index_topk(q, index, k, probes=probes, exact=True, most=3)) == keys(R.dense_topk(q, c, k, per_collection=False))


def test_cells_that_nobody_probes_are_not_opened(spark, vectors):
    q, c = vectors
    index = D.build_index(c, shared_folder(spark, "t"), cells=12)
    near = D.index_topk(q.where("qid = 0"), index, 5, probes=2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and plan.split("cell#")[0]
    files = {f.rsplit("cell=", 1)[1].split("/")[0] for f in index.vectors(spark, index.nearest_cells(R.unit(np.array([q.where("qid = 0").first().qvec], float)), 2)[0].tolist()).inputFiles()}
    assert len(files) == 12  # listed, but the filter keeps two
    assert index.vectors(spark, [3]).select(F.input_file_name().alias("f")).distinct().where("f not like '%cell=3/%'").count() == 0


def test_centroids_do_not_depend_on_partitions(spark, vectors):
    _, c = vectors
    a, b = (D.fit_centroids(c.repartition(n), 7, rounds=3, sample=300) for n in (1, 6))
    assert np.allclose(a, b, atol=1e-12) and len(a) == 7


def test_odd_vectors(spark):
    r = random.Random(1)
    rows = [(i, "x" if i % 2 else None, [0.0, 0.0] if i % 5 == 0 else None if i % 7 == 0 else [r.choice([0.5, -0.5]), r.choice([1.0, -2.0])]) for i in range(60)]
    c = spark.createDataFrame(rows + rows[:9], "id long, collection string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])], "qid long, qvec array<double>")
    same = lambda df: sorted((x.qid, x["rank"], x.id, round(x.sim, 8)) for x in df.collect())
    index = D.build_index(c, shared_folder(spark, "t"))
    # a zero vector's angle says nothing, so only queries with a direction are compared
    assert same(D.index_topk(q, index, 6, exact=True).where("qid = 1")) == same(R.dense_topk(q, c, 6, per_collection=False).where("qid = 1"))
    for odd in (c.where("false"), c.where("id % 5 = 0")):
        got = D.index_topk(q, D.build_index(odd, shared_folder(spark, "t")), 3, exact=True)
        assert same(got) == same(R.dense_topk(q, odd, 3, per_collection=False))
