"""Lloyd iterations against plain Python integers."""

import hashlib
import math
import random

import duckdb
import pytest

from folioscope.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, n int, v binary"


def brute(rows, dim, k, rounds, scale=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(cents)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    by = [sum(d for _, c, d in got if c == x) for x in range(k)]
    return sorted(((i, c, d, by[c], sum(by), sha[c]) for i, c, d in got), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", 1, b"y") for i, e in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("n,k,rounds", [(200, 7, 3), (5, 7, 2), (40, 3, 0), (60, 16, 5)])
def test_rows_equal_plain_integers(spark, n, k, rounds):
    r = random.Random(n)
    rows = [(r.randrange(n), [r.choice([-1.5, 0.25, -0.01, r.gauss(0, 1)]) for _ in range(4)]) for _ in range(n)]
    rows += rows[:3] + [(None, [0.5, 0.5, -0.5, 0.0])]
    got = clusters.lloyd(frame(spark, rows), dim=4, k=k, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4, k, rounds)


def test_unusable_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [0.0, 0.0]), (8, [-0.001, 2.0]), (9, [1.0, 2.0, 3.0])]
    got = clusters.lloyd(frame(spark, rows), dim=2, k=2)
    assert sorted(r.vec_id for r in got.collect()) == [7, 8]
    assert clusters.lloyd(frame(spark, rows[:6]), dim=2, k=2).collect() == []
    assert clusters.lloyd(frame(spark, rows).where("false"), dim=2).collect() == []


def test_equal_vectors_go_to_the_lowest_centroid(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)]
    got = clusters.lloyd(frame(spark, rows), dim=2, k=4).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 30


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        clusters.lloyd(frame(spark, [(1, [1e30, 0.0])]), dim=2, k=1).collect()


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = con.sql(clusters.OP12_SQL)
    got = clusters.op12_centroid_clustering(spark, data).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []
