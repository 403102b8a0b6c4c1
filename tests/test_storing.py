"""Tables in buckets, the sink with commits, and stored corpora."""

import glob
import os
import random
import subprocess
import sys

import pytest

from folioscope.operators import buckets as B
from folioscope.operators import records as R
from folioscope.operators import stored as K
from folioscope.sources.committed import CommittedSink, committed, sweep
from folioscope.streaming import conversations as C

ROWS = "id long, version int, text string"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/*/*.parquet")}


def test_a_load_rewrites_only_its_buckets(spark, tmp_path):
    t = B.BucketTable.create(spark, str(tmp_path / "t"), "id", ROWS, 16)
    assert t.read(spark).collect() == [] and B.BucketTable.open(spark, t.path) == t
    with pytest.raises(Exception, match="(?i)already exists"):
        B.BucketTable.create(spark, t.path, "id", ROWS, 4)
    old = spark.createDataFrame([(i, 1, "old") for i in range(400)] + [(None, 1, "none")], ROWS)
    assert len(B.upsert_into(t, old)) == 16
    before = files(t.path)
    new = spark.createDataFrame([(3, 2, "new"), (3, 2, "newer"), (5, 0, "late"), (None, 2, "none again")], ROWS)
    touched = B.upsert_into(t, new)
    assert 1 <= len(touched) <= 3
    after = files(t.path)
    kept = {f for f in before if int(f.split("bucket_=")[1].split("/")[0]) not in touched}
    assert kept and all(after[f] == before[f] for f in kept) and not (set(before) - kept) & set(after)
    assert sorted(map(repr, t.read(spark).collect())) == sorted(map(repr, R.upsert(old, new).collect()))
    # a load that is repeated, an empty one, and a look-up that opens one bucket
    again = sorted(map(repr, t.read(spark).collect()))
    assert B.upsert_into(t, new) == touched and sorted(map(repr, t.read(spark).collect())) == again
    assert B.upsert_into(t, new.where("false")) == []
    found = t.rows_of(spark, [3])
    assert [r.text for r in found.collect()] == ["newer"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket_#" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("seed", range(3))
def test_random_loads_equal_one_upsert(spark, tmp_path, seed):
    r = random.Random(seed)
    t = B.BucketTable.create(spark, str(tmp_path / "t"), "id", ROWS, 5)
    best = {}
    for load in range(3):
        rows = [(r.randrange(30), r.randrange(4), f"{load}{r.randrange(9)}") for _ in range(r.randrange(1, 25))]
        for i, v, text in rows:
            best[i] = max(best.get(i, (-1, -1, "")), (v, load, text))
        B.upsert_into(t, spark.createDataFrame(rows, ROWS))
    assert {x.id: (x.version, x.text) for x in t.read(spark).collect()} == {i: (v, text) for i, (v, _, text) in best.items()}


def test_evaluations_attach_once_though_their_batch_runs_twice(spark, tmp_path):
    t = B.BucketTable.create(spark, str(tmp_path / "t"), "question", B.TRACES, 8)
    rows = spark.createDataFrame([(1, "q", None, None), (2, "q", None, None), (3, "q", "came", None), (4, "r", None, None), (5, None, None, None)], B.TRACES)
    t.rewrite(rows, lambda old, new: new)
    evals = spark.createDataFrame([("q", "first"), ("nobody", "x"), (None, "y")], "question string, eval string")
    for _ in range(2):
        B.attach_evals(t, evals, 0)
        assert {x.seq: x.eval for x in t.read(spark).collect()} == {1: None, 2: "first", 3: "came", 4: None, 5: None}
    B.attach_evals(t, evals, 1)
    assert {x.seq: (x.eval, x.eval_batch) for x in t.read(spark).collect()} == {1: ("first", 1), 2: ("first", 0), 3: ("came", -1), 4: (None, None), 5: (None, None)}


def test_evaluations_of_several_batches_as_a_stream(spark, tmp_path):
    t = B.BucketTable.create(spark, str(tmp_path / "t"), "question", B.TRACES, 8)
    t.rewrite(spark.createDataFrame([(i, f"q{i % 3}", None, None) for i in range(9)], B.TRACES), lambda old, new: new)
    for n in range(2):
        spark.createDataFrame([("q0", f"e{n}")], "question string, eval string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = files(t.path)
        C.merge_evals_in_buckets(spark.readStream.schema("question string, eval string").parquet(str(tmp_path / "in")), t, str(tmp_path / "cp")).awaitTermination()
        assert len(before.items() - files(t.path).items()) == 1  # the one bucket of q0
    assert {x.seq: x.eval for x in t.read(spark).where("eval is not null").collect()} == {6: "e0", 3: "e1"}


def test_committed_loads_are_read_and_repeated_ones_are_not_doubled(spark, tmp_path):
    spark.dataSource.register(CommittedSink)
    at, schema = str(tmp_path / "sink"), "a long, b string"
    assert committed(spark, at, schema).collect() == []
    put = lambda df, load=None: df.write.format("committed").options(path=at, **({"load": load} if load else {})).mode("append").save()
    one = spark.createDataFrame([(1, "x"), (2, None)], schema).repartition(2)
    put(one, "a/b é")
    put(one, "a/b é")
    assert sorted(r.a for r in committed(spark, at, schema).collect()) == [1, 2]
    put(one)
    put(one.where("false"))
    assert sorted(r.a for r in committed(spark, at, schema).collect()) == [1, 1, 2, 2]
    with pytest.raises(Exception, match="appends"):
        one.write.format("committed").option("path", at).mode("overwrite").save()


def test_a_failed_load_leaves_no_rows(spark, tmp_path):
    spark.dataSource.register(CommittedSink)
    at = str(tmp_path / "sink")

    def broken(frames):
        for f in frames:
            yield f
            if (f.a == 7).any():
                raise RuntimeError("no such row")

    rows = spark.range(0, 100, 1, 4).toDF("a").mapInPandas(broken, "a long")
    with pytest.raises(Exception, match="no such row"):
        rows.write.format("committed").option("path", at).mode("append").save()
    assert committed(spark, at, "a long").collect() == [] and glob.glob(f"{at}/commits/*") == []
    # tasks that were killed may leave files that no list names
    spark.range(3).toDF("a").coalesce(1).write.format("committed").option("path", at).mode("append").save()
    left = len(glob.glob(f"{at}/data/*")) - 1
    assert sweep(spark, at) == 0 and sweep(spark, at, 0) == left and len(glob.glob(f"{at}/data/*")) == 1
    assert sorted(r.a for r in committed(spark, at, "a long").collect()) == [0, 1, 2]


_RETRIED = """
import sys
from pyspark.sql import SparkSession
from pyspark import TaskContext
from folioscope.sources.committed import CommittedSink, committed
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()
spark.dataSource.register(CommittedSink)
def once(frames):
    for i, f in enumerate(frames):
        yield f
        if i == 2 and TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() != 1:
            raise RuntimeError("first attempt")
rows = spark.range(0, 200, 1, 4).toDF("a").mapInPandas(once, "a long")
rows.write.format("committed").option("path", sys.argv[1]).mode("append").save()
got = sorted(r.a for r in committed(spark, sys.argv[1], "a long").collect())
print("equal" if got == list(range(200)) else got)
"""


def test_task_attempts_that_fail_leave_no_doubled_rows(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", _RETRIED, str(tmp_path / "sink")], cwd=root, capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": root})
    assert out.stdout.strip().endswith("equal"), out.stdout + out.stderr[-3000:]
    assert len(glob.glob(f"{tmp_path}/sink/data/*")) == 4


def test_a_batch_that_is_committed_again_is_there_once(spark, tmp_path):
    spark.dataSource.register(CommittedSink)
    at = str(tmp_path / "sink")
    for n in range(2):
        spark.createDataFrame([(n,)], "a long").write.mode("append").json(str(tmp_path / "in"))
        q = spark.readStream.schema("a long").json(str(tmp_path / "in")).writeStream.format("committed").option("path", at).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    # the last batch's commit is lost, as where the driver dies after the sink's: it runs again
    for f in ("1", ".1.crc"):
        os.remove(tmp_path / "cp" / "commits" / f)
    spark.readStream.schema("a long").json(str(tmp_path / "in")).writeStream.format("committed").option("path", at).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.a for r in committed(spark, at, "a long").collect()) == [0, 1]
    assert len(glob.glob(f"{at}/commits/*")) == 2 and len(glob.glob(f"{at}/data/*")) == 3


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_stored_corpus_is_not_shuffled(spark, tmp_path):
    records = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id long, text string")
    K.store(records.repartition(3), "stored_test", buckets=8, path=str(tmp_path / "s"))
    assert len(glob.glob(str(tmp_path / "s" / "*.parquet"))) == 8
    rows = spark.createDataFrame([(5, "a"), (250, "b"), (5, "c"), (None, "d")], "id long, n string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new, got = K.load_new(rows, "stored_test"), K.gather(rows, "stored_test")
        # before anything runs the plan shows what will be shuffled: the rows of the load, once
        assert exchanges(new) == 1 and exchanges(got) == 1
        assert sorted(r.n for r in new.collect()) == ["b", "d"] and sorted((r.n, r.text) for r in got.collect()) == [("a", "t5"), ("c", "t5")]
        K.store(rows.where("id = 250").selectExpr("id", "n as text"), "stored_test", buckets=8, path=str(tmp_path / "s"), mode="append")
        later = K.load_new(rows, "stored_test")
        assert exchanges(later) == 1 and [r.n for r in later.collect()] == ["d"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="text"):
        K.gather(rows.withColumnRenamed("n", "text"), "stored_test")
    spark.sql("drop table stored_test")
