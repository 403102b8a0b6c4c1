"""Citation guard, refusals, predicates and small text rules."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import routing
from folioscope.functions import text as T
from folioscope.operators import scorers


def row(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize("text, want", [("a [B4.3.5(5)] b", "a b"), ("x  [B4.3.5(5)]  y", "x y"), ("[K] ok", "[K] ok")])
def test_strip(spark, text, want):
    valid = F.array(F.lit("K"))
    assert row(spark, T.strip_citations(F.col("t"), T.invalid_citations(F.col("t"), valid)), "t string", text) == want


def test_invalid_citations_are_distinct_in_order(spark):
    assert row(spark, T.invalid_citations(F.col("t"), F.array(F.lit("K"))), "t string", "[b][K][a][b]") == ["b", "a"]


def test_gate(spark):
    for strict, text, want in [
        (True, "a long enough answer [K] and [bad]", (True, ["K"], "a long enough answer [K] and [bad]")),
        (True, "a long enough answer without", (False, [], "no")),
        (False, "a long enough answer [bad]", (True, [], "a long enough answer")),
        (False, "근거를 찾지 못했습니다 [K] 라고 답한다", (False, ["K"], "no")),
    ]:
        r = row(spark, T.answer_gate(F.col("t"), F.array(F.lit("K")), strict, F.lit("no")), "t string", text)
        assert (r.has_grounds, list(r.used_refs), r.text) == want


@pytest.mark.parametrize("scores, retried, want", [([0.3], False, True), ([0.6], False, False), ([], False, True), ([0.3], True, False), ([0.5, 0.9], False, True)])
def test_retry(spark, scores, retried, want):
    assert row(spark, T.retry_needed(F.col("s"), F.col("r")), "s array<double>, r boolean", scores, retried) is want


def test_json_object(spark):
    cases = {'x {"a": 1} y': '{"a": 1}', '{"a": 1} {"b": 2}': None, "none": None, '{"a": {"b": 2}}': '{"a": {"b": 2}}', "{bad}": None}
    for text, want in cases.items():
        assert row(spark, T.json_object(F.col("t")), "t string", text) == want


def test_small_rules(spark):
    assert row(spark, T.file_name(F.col("t")), "t string", 'a/b:c?"') == "a_b_c__"
    assert row(spark, T.file_name(F.col("t")), "t string", "  ") == "unnamed"
    assert row(spark, T.official_number(F.col("t")), "t array<string>", [None, "x 2025-I-KQA006.hwp", "2025-G-KQA001"]) == "2025-I-KQA006"
    assert row(spark, T.without_page_marks(F.col("t")), "t string", "a\n 2/8 \nb") == "a\nb"
    assert row(spark, T.markdown_escape(F.col("t")), "t string", "a*b_[c]") == r"a\*b\_\[c\]"
    assert row(spark, scorers.rewritten(F.col("t"), F.lit("q")), "t string", "  ") == "q"
    assert row(spark, scorers.judged(F.col("t")), "t double", 1.7) == 1.0


def test_routing(spark):
    route = lambda q, asked, kind: row(spark, routing.route(F.col("q"), F.col("a"), F.col("k")), "q string, a array<string>, k string", q, asked, kind)
    assert route("중소기업 질문", ["qa_kifrs"], None) == ["qa_kgaap", "kgaap_standards"]
    assert route("상장 기업", ["kifrs_standards", "x"], None) == ["kifrs_standards"]
    assert set(route("비상장 회사", ["qa_kgaap"], None)) == set(routing.COLLECTIONS)
    assert route("일반기업", ["qa_kgaap"], "정의조회") == ["qa_kgaap", "kifrs_standards"]
    assert route("일반기업", ["kgaap_standards", "qa_kgaap"], "사례시나리오") == ["qa_kgaap", "kgaap_standards"]
    assert row(spark, routing.known(F.col("a")), "a array<string>", ["none"]) == list(routing.COLLECTIONS)
