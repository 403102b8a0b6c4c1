"""The table function over tables: threads apart and in order, schema from its arguments."""

import pytest

from folioscope.operators import exchanges as X


def test_exchanges(spark):
    X.register(spark)
    rows = [("a", 3, "assistant", "x"), ("a", 1, "user", "q"), ("a", 2, "user", None), ("a", 4, "assistant", "y"), ("a", 5, "system", "s"), ("a", 6, "user", "again"), ("b", 1, "assistant", "alone"), (None, 1, "user", "z"), ("c", 1, "system", "s")]
    spark.createDataFrame(rows, "`my thread` string, at int, who string, said string").repartition(3).createOrReplaceTempView("talk_")
    out = spark.sql("SELECT * FROM exchanges(TABLE(talk_), 'my thread', 'at', 'who', 'said')")
    assert out.columns == ["my thread", "at", "question", "answer", "messages"] and out.schema["at"].dataType.simpleString() == "int"
    want = [("a", 1, "q\n", "x\ny", 4), ("a", 6, "again", None, 1), ("b", 1, None, "alone", 1), (None, 1, "z", None, 1)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert spark.sql("SELECT * FROM exchanges(TABLE(SELECT * FROM talk_ WHERE false), 'my thread', 'at', 'who', 'said')").count() == 0


def test_wrong_column(spark):
    X.register(spark)
    spark.range(1).createOrReplaceTempView("ids_")
    with pytest.raises(Exception, match="is not a column of the table"):
        spark.sql("SELECT * FROM exchanges(TABLE(ids_), 'id', 'turn', 'role', 'text')").collect()
