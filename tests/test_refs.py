"""Citation keys: extraction, ranges, lists, chapters, international notation."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import refs as C


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return df.select(column.alias("r")).first().r


def keys(spark, text):
    return one(spark, C.extract_refs(F.col("t")), t=text)


P = "제1109호 문단 {}".format


@pytest.mark.parametrize(
    "text, want",
    [
        ("제1102호 문단 10~12를 참조", [f"제1102호 문단 {n}" for n in (10, 11, 12)]),
        ("제1109호 문단 B9~B31 참조", [P(f"B{n}") for n in range(9, 32)]),
        ("제1039호 문단 BC322~BC325", [f"제1039호 문단 BC{n}" for n in range(322, 326)]),
        ("제1001호 문단 1~200", ["제1001호 문단 1", "제1001호 문단 200"]),
        ("제1001호 문단 9~3", ["제1001호 문단 9", "제1001호 문단 3"]),
        ("제1109호 문단 9, 문단 BC40, 문단 BC41", [P("9"), P("BC40"), P("BC41")]),
        ("제1116호 문단 7⑴을 적용한다", ["제1116호 문단 7⑴"]),
        ("제10장 문단 10.14~10.16", [f"제10장 문단 10.{n}" for n in (14, 15, 16)]),
        ("제15장 문단 5~7", [f"제15장 문단 15.{n}" for n in (5, 6, 7)]),
        ("제02장", ["제2장"]),
        ("제31장 문단 9⑴", ["제31장 문단 31.9⑴"]),
        ("제6장 문단 5.5", ["제6장 문단 5.5"]),
        ("제1116호 ‘리스  기준’의 문단 9", ["제1116호 '리스 기준'", "제1116호 문단 9"]),
        ("(제1109호 용어의 정의)", ["제1109호", "제1109호 용어의 정의"]),
        ("제1109호　문단 7", [P("7")]),
        ("제1109호 문단 9.", [P("9")]),
        ("", []),
        (None, []),
    ],
)
def test_extract(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.extract_refs(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("IAS 29 문단 3", ["제1029호 문단 3"]),
        ("IFRS 9 '금융상품'", ["제1109호 '금융상품'"]),
        ("K-IFRS 9", []),
        ("IFRS 9를", []),
        ("한국IFRS 9 ", []),
        ("IFRIC 12, SIC 7", ["제2112호", "제2007호"]),
    ],
)
def test_international(spark, text, want):
    assert one(spark, C.extract_international(F.col("t")), t=text) == want


def test_all_refs_puts_national_keys_first_and_uses_the_body_only_without_a_question(spark):
    df = spark.createDataFrame([("IFRS 9 문단 5.1을 참조하며 제1109호와 비교", None, "제1001호"), (None, None, "제1002호")], "q string, a string, b string")
    none = F.lit(None).cast("string")
    got = [r[0] for r in df.select(C.all_refs(none, F.col("q"), F.col("a"), none, F.col("b"))).collect()]
    assert got == [["제1109호", "제1109호 문단 5.1"], ["제1002호"]]


def test_kinds(spark):
    want = {"제1116호 문단 7⑴": "문단", "제10장 문단 10.14": "장문단", "제1109호 용어의 정의": "용어섹션", "제1116호 '리스'": "제목", "제2장 '표'": "장제목", "제1109호": "단독호", "제2장": "단독장", "x": "기타"}
    df = spark.createDataFrame([(k,) for k in want], ["k"])
    assert {r.k: r.n for r in df.select("k", C.kind_of(F.col("k")).alias("n")).collect()} == want


def test_nfkc(spark):
    from folioscope.functions.nfkc import nfkc_key

    df = spark.createDataFrame([("제1116호 문단 7⑷",), (None,)], "k string")
    assert [r[0] for r in df.select(nfkc_key(F.col("k"))).collect()] == ["제1116호문단7(4)", None]
