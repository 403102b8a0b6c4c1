"""Streams: history per thread as state, first records, traces and their evaluations."""

from pyspark.sql import functions as F

from folioscope.streaming import conversations as C


def test_thread_history_goes_on_over_batches(spark, tmp_path):
    schema = "thread string, seq long, role string, content string"
    for i, rows in enumerate([[("t", 1, "user", "a"), ("t", 2, "assistant", "b")], [("t", 3, "user", "c"), ("u", 1, "user", "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = C.thread_history(spark.readStream.schema(schema).json(str(tmp_path / "in")), n=2)
        q = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.thread, r.seq): [h.content for h in r.history] for r in spark.read.schema(C.HISTORY).json(str(tmp_path / "out")).collect()}
    assert got == {("t", 1): [], ("t", 2): ["a"], ("t", 3): ["a", "b"], ("u", 1): []}
    # each batch was a query of its own, started again from the checkpoint; its state is a table
    held = C.held_messages(spark, str(tmp_path / "cp")).collect()
    assert sorted(map(tuple, held)) == [("t", "assistant", "b"), ("t", "user", "c"), ("u", "user", "x")]


def test_quiet_threads_and_old_messages_are_forgotten(spark, tmp_path):
    schema = "thread string, seq long, role string, content string"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for name, limits in (("quiet", {"quiet_ms": 1}), ("old", {"keep_ms": 1}), ("kept", {"quiet_ms": 10**9, "keep_ms": 10**9})):
        for seq in (1, 2):
            spark.createDataFrame([("t", seq, "user", None), ("once", 1, "user", "x")][: 3 - seq], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = C.thread_history(spark.readStream.schema(schema).parquet(str(tmp_path / name / "in")), **limits)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        got = {(r.thread, r.seq): len(r.history) for r in spark.read.parquet(str(tmp_path / name / "out")).collect()}
        held = C.held_messages(spark, str(tmp_path / name / "cp")).count()
        assert (got, held) == ({("t", 1): 0, ("once", 1): 0, ("t", 2): int(name == "kept")}, 3 if name == "kept" else 1), name
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_trace_is_appended_clipped_and_merged(spark, tmp_path):
    spark.createDataFrame([("q", "x" * 400)], "question string, answer string").write.json(str(tmp_path / "in"))
    C.append_trace(spark.readStream.schema("question string, answer string").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert len(spark.read.json(str(tmp_path / "out")).first().answer) == 300

    trace = spark.createDataFrame([(1, "q", None), (2, "q", None), (3, "q", "done"), (4, "r", None)], "seq long, question string, eval string")
    trace.write.parquet(str(tmp_path / "trace" / "v=0"))
    spark.createDataFrame([("q", "new")], "question string, eval string").write.json(str(tmp_path / "ev"))
    C.merge_evals(spark.readStream.schema("question string, eval string").json(str(tmp_path / "ev")), str(tmp_path / "trace"), str(tmp_path / "cp2")).awaitTermination()
    got = {r.seq: r.eval for r in spark.read.parquet(str(tmp_path / "trace" / "v=1")).collect()}
    assert got == {1: None, 2: "new", 3: "done", 4: None}


def test_first_record_of_each_id(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, v int").withColumn("ts", F.current_timestamp()).write.json(str(tmp_path / "in"))
    s = C.new_records(spark.readStream.schema("id string, v int, ts timestamp").json(str(tmp_path / "in")))
    s.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]
