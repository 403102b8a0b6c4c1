"""Shuffle files of finished rounds do not pile up."""

import time

from folioscope.llm import base
from folioscope.llm import components as C


def test_files_of_a_frame_that_is_gone_are_deleted(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    df = spark.range(1000).repartition(7).repartition(5, "id")
    assert df.count() == 1000
    there = files.getAllFiles().size()
    del df
    for _ in range(20):  # Spark's cleaner works beside the job
        base.let_go(spark)
        if files.getAllFiles().size() < there:
            break
        time.sleep(0.5)
    assert files.getAllFiles().size() < there


def test_every_round_lets_its_files_go(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(C, "let_go", rounds.append)
    found = C.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(21)}
    assert len(rounds) >= 2
