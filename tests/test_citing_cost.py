"""Citations: a text is normalised once, marks in texts do no harm, kinds are those of the first pattern that fits."""

from pyspark.sql import functions as F

from folioscope.functions import refs as C


def test_a_text_is_normalised_once(spark):
    df = spark.createDataFrame([("제1109호 문단 1~3",)], "t string").select(C.extract_refs(F.col("t")).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().count("translate(") == 1
    assert df.first().r == ["제1109호 문단 1", "제1109호 문단 2", "제1109호 문단 3"]


def test_groups_of_texts_with_the_mark(spark):
    texts = ["제1109호 '리스' 문단 3, 문단 5", "제1109호 '리\x01스' 문단 3", "제1109호\x01 문단 3", "제5장 문단 7~9", "제5장 '가$1나' 문단 5.2", "호 장", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.extract_refs(F.col("t")).alias("r"))
    got = {x.i: x.r for x in rows.collect()}
    assert got[0] == ["제1109호 '리스'", "제1109호 문단 3", "제1109호 문단 5"] and got[1] == ["제1109호 '리\x01스'", "제1109호 문단 3"]
    assert got[2] == ["제1109호 문단 3"] and got[3] == ["제5장 문단 5.7", "제5장 문단 5.8", "제5장 문단 5.9"]
    assert got[4] == ["제5장 '가$1나'", "제5장 문단 5.2"] and got[5] == got[6] == got[7] == []


def test_kinds_are_those_of_the_first_pattern(spark):
    keys = [f"{a}{b}" for a in ("제1109호", "제5장", "제12장", "제5호", "제123장", "x", "") for b in ("", " 문단 3", " '가'", " '가 문단'", " 용어의 정의", " 용어의 정의:x", "\n문단 1")] + [None]
    first = F.lit("기타")
    for name, pattern in reversed(C.KINDS):
        first = F.when(F.col("k").rlike(pattern), F.lit(name)).otherwise(first)
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", C.kind_of(F.col("k")).alias("got"), first.alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == []
