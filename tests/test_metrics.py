"""Metrics at k: gathered hits are never broadcast, and places of keys say what their parts say."""

from itertools import product

from pyspark.sql import functions as F

from folioscope.operators import joins, metrics

GOLD = "qid long, board string, expected array<string>"
HITS = "qid long, rank int, ref_key string, section_key string"


def test_gathered_hits_are_not_broadcast(spark):
    gold = spark.range(10).select(F.col("id").alias("qid"), F.lit("b").alias("board"), F.array(F.lit("제1001호 문단 1")).alias("expected"))
    hits = spark.range(10).selectExpr("id as qid", "explode(sequence(1, 13)) as rank", "'제1001호 문단 2' as ref_key", "string(null) as section_key")
    out = metrics.evaluate(gold, hits)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.relaxed, r.nhit) for r in out.collect()} == {(5, 0.5, 0), (10, 0.5, 0)}


def test_places_are_neighbours_where_parts_are(spark):
    labels = ["1", "2", "02", "010", "9", "10", "B1", "B2", "B2A", "3.9", "3.10", "7⑴", "8⑴", "x 문단 2", "1x 문단 2", "a1b", "", "A", "1\n", "0", "000", "1 "]
    keys = [f"{a} 문단 {b}" for a in ("제1001호", "제1002호", "제1장", "제1001호 일부", "다른 제1001호") for b in labels] + ["제1001호", "제1001호 용어의 정의", "", "문단 2"]
    rows = spark.createDataFrame([(a, b) for a, b in product(keys, keys)], "a string, b string").repartition(4)
    near = F.coalesce(F.array_contains(metrics.beside(F.col("a")), metrics.place(F.col("b"))), F.lit(False))
    got = rows.select("a", "b", joins.adjacent(F.col("a"), F.col("b")).alias("want"), near.alias("got")).collect()
    assert [r for r in got if r.want != r.got] == [] and sum(r.want for r in got) > 50


def test_repeated_keys_count_once(spark):
    gold = spark.createDataFrame([(1, "b", ["제1001호 문단 1", "제1001호 문단 5"]), (2, "b", ["제1001호"]), (3, "b", None)], GOLD)
    hits = spark.createDataFrame([(1, 1, "제1001호 문단 1", None), (1, 7, "제1001호 문단 1", ""), (1, 2, "제1001호 문단 4", "제1001호 문단 1")], HITS)
    got = {(r.qid, r.k): (r.nhit, r.exact, r.relaxed, r.ho) for r in metrics.evaluate(gold, hits).collect()}
    assert got[1, 5] == got[1, 10] == (1, 0.5, 0.75, 1.0) and got[2, 5] == got[3, 10] == (0, 0.0, 0.0, 0.0)
