"""Running guards over ranges, versions of one id, global numbers."""

import random

import pytest

from folioscope.operators import records as Rec


@pytest.mark.parametrize("seed", range(4))
def test_guard_equals_counting_row_by_row(spark, seed):
    r = random.Random(seed)
    rows = [(b, i, r.choice([True, False, False, None])) for b in ("a", "b", None) for i in r.sample(range(1000), r.randrange(1, 300))]
    want = {}
    for b in ("a", "b", None):
        n = f = 0
        want[b] = None
        for _, i, x in sorted((x for x in rows if x[0] == b), key=lambda x: x[1]):
            n, f = n + 1, f + bool(x)
            if n >= 20 and f / n > 0.25 and want[b] is None:
                want[b] = i
    df = spark.createDataFrame(r.sample(rows, len(rows)), "board string, seq long, fallback boolean").repartition(3)
    got = Rec.guard(df, 0.25)
    assert {x.board: x.tripped_at for x in got.collect()} == want
    assert Rec.guard(df.where("false")).collect() == []


def test_equal_versions_do_not_depend_on_partitions(spark):
    old = spark.createDataFrame([(1, 1, "old"), (2, 3, "old"), (3, 1, "only")], "id long, version int, text string")
    new = spark.createDataFrame([(1, 1, "new a"), (1, 1, "new b"), (2, 2, "late")], "id long, version int, text string")
    for n in (1, 5):
        got = Rec.upsert(old.repartition(n), new.repartition(n))
        assert {r.id: r.text for r in got.collect()} == {1: "new b", 2: "old", 3: "only"} and got.columns == old.columns


def test_numbers_follow_the_order(spark):
    r = random.Random(3)
    rows = [(x,) for x in r.sample(range(10_000), 500)]
    got = Rec.numbered(spark.createDataFrame(rows, "x long").repartition(6), "x")
    assert [x.row_no for x in got.orderBy("x").collect()] == list(range(500))
    assert not spark.sparkContext._jsc.getPersistentRDDs()
