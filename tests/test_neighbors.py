"""Neighbours of keys: tasks grow in number with the keys, not in size."""

from folioscope.operators import joins


def test_tasks_are_as_many_as_the_keys_ask_for(spark):
    corpus = spark.createDataFrame([(f"제1001호 문단 {n}",) for n in range(0, 9)], "ref_key string")
    for n in (1000, 4000):
        keys = spark.range(n).selectExpr("id div 4 as qid", "concat('제1001호 문단 ', 1 + id % 4 * 2) as ref_key")
        got = joins.with_neighbors(keys.unionByName(keys), corpus, most=100)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert f", {n // 50})" in plan and "REPARTITION_BY_NUM" in plan
        assert plan.count("HashAggregate(keys=[qid#") == 2 and plan.index("REPARTITION_BY_NUM") > plan.rindex("HashAggregate(keys=[qid#")  # none below the shuffle
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == {(q, f"제1001호 문단 {i}") for q in range(n // 4) for i in range(9)}
