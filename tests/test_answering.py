"""The answering plan end to end with stand-in models, and corpus building."""

from pyspark.sql import functions as F

from folioscope.operators import answering as A
from folioscope.operators import corpus as C
from folioscope.operators.scorers import scorer
from folioscope.sources import html


def embed(text):
    return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))


def test_questions_are_answered_once_with_verified_evidence(spark):
    corpus = spark.createDataFrame(
        [(i, c, p, i, f"K{i}" if i % 2 else None, f"D{i}", f"text {i} lease", [float(i), 1.0]) for i, (c, p) in enumerate([("qa_kifrs", 0), ("kifrs_standards", 2), ("qa_kgaap", 1), ("kgaap_standards", 3)] * 3)],
        "id long, collection string, coll_pos int, lineno long, ref_key string, doc_no string, text string, vec array<float>",
    )
    cases = spark.createDataFrame([(1, "c1", "lease case", [9.0, 1.0]), (2, "c2", "other", [-9.0, 1.0])], "id long, case_id string, text string, vec array<float>")
    q = spark.createDataFrame(
        [(1, "what is a lease", None), (2, "and then", [("user", "x")]), (3, "refuse", None)], "qid long, question string, history array<struct<role:string,content:string>>"
    )
    models = A.Models(
        rewrite=lambda question, history: F.concat(question, F.lit(" rewritten")),
        route=lambda question: F.lit('so: {"collections": ["qa_kifrs", "nope"], "qtype": "일반"}'),
        answer=lambda question, ctx: F.when(question == "refuse", F.lit("short")).otherwise(F.concat(F.lit("see the evidence ["), F.regexp_extract(ctx, r"^\[([^\]]+)\]", 1), F.lit("] and [made up]"))),
        rerank=scorer("overlap"),
    )
    out = {r.qid: r for r in A.answer_questions(q, corpus, cases, models, embed, k=4, per_coll=2).collect()}
    assert len(out) == 3
    # the first hit of question 1 scores low, so it is rewritten and retrieved for once more; question 2 was rewritten for its history
    assert out[1].rewritten == "what is a lease rewritten" and out[2].rewritten == "and then rewritten"
    assert {q: r.retry for q, r in out.items()} == {1: True, 2: False, 3: True} and out[1].question == "what is a lease"
    assert list(out[1].route.collections)[0] == "qa_kifrs" and len(out[1].route.collections) == 4
    assert len(out[1].retrieved_refs) == 4 and out[1].has_grounds and list(out[1].used_refs) == [out[1].retrieved_refs[0]]
    assert [v.ref for v in out[1].verified] == list(out[1].used_refs)
    assert not out[3].has_grounds and out[3].answer == A.REFUSAL_TEXT and list(out[3].verified) == []
    nxt = {r.qid: r.history for r in A.next_history(spark.createDataFrame([(2, "and then", "a")], "qid long, question string, answer string"), q).collect()}
    assert [(m.role, m.content) for m in nxt[2]] == [("user", "x"), ("user", "and then"), ("assistant", "a")]


def test_a_high_first_score_is_not_retried(spark):
    df = spark.createDataFrame([(1, [0.6], False), (2, [0.3], False), (3, [0.3], True), (4, None, False)], "i int, s array<double>, done boolean")
    good, low = A.split_by(df, A.T.retry_needed(F.coalesce("s", F.array().cast("array<double>")), F.col("done")))
    assert {r.i for r in good.collect()} == {1, 3} and {r.i for r in low.collect()} == {2, 4}


def test_low_questions_alone_are_retrieved_again(spark):
    asked = spark.createDataFrame([(1, "good", False), (2, "low", False), (3, "low", True), (4, "none", False), (5, "worse", False), (6, "low", None)], "qid long, word string, retried boolean")
    hits = {"good": [(1, 0.6), (2, 0.1)], "low": [(1, 0.59), (2, 0.9)], "none": [], "worse": [(1, 0.5)], "low again": [(1, 0.2)], "none again": [(1, 0.3), (2, 0.1)], "worse again": []}
    table = spark.createDataFrame([(w, s, f"{w}-{s}", x) for w, rows in hits.items() for s, x in rows], "word string, slot long, id string, score double")
    seen = []

    def retrieve(q):
        seen.append(sorted(r.word for r in q.collect()))
        return q.join(table, "word").select("qid", "slot", "id", "score")

    got = A.retrieved_again(asked, retrieve, lambda low: low.withColumn("word", F.concat("word", F.lit(" again"))))
    rows = {q: sorted((r.slot, r.id, r["pass"]) for r in got.collect() if r.qid == q) for q in range(1, 7)}
    assert seen == [["good", "low", "low", "low", "none", "worse"], ["low again", "low again", "none again", "worse again"]]
    assert rows[1] == [(1, "good-1", 0), (2, "good-2", 0)] and rows[3] == [(1, "low-1", 0), (2, "low-2", 0)]
    assert rows[2] == rows[6] == [(1, "low again-1", 1)] and rows[4] == [(1, "none again-1", 1), (2, "none again-2", 1)] and rows[5] == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.splitlines()) < 30  # what was retrieved is read, not planned again


def test_second_attempt_only_for_invalid_citations(spark):
    rows = spark.createDataFrame([(1, "fine answer with [A] cited", ["A"]), (2, "an answer with [X] cited", ["A"]), (3, "short [X]", ["A"])], "i int, question string, refs array<string>").withColumn("evidence", F.lit("e"))
    model = lambda q, e: F.when(e.contains("X"), F.lit("now with [A] and [Y] cited")).otherwise(q)
    assert {r.i: r.said for r in A.answered(rows, model).collect()} == {1: "fine answer with [A] cited", 2: "now with [A] and cited", 3: "short"}
    assert {r.i: r.said for r in A.answered(rows, model, strict=True).collect()}[2] == "an answer with [X] cited"


def test_judge_keeps_old_evaluations_and_odd_outputs_are_null(spark):
    old = (0.5, [], None, "", "v", "m")
    trace = spark.createDataFrame([(1, "q", "a", "g", old), (2, None, None, None, None), (3, "q", "broken", "g", None)], f"seq long, question string, answer string, grounding string, eval {A.EVAL}")
    judge = lambda kind, p, attempt: F.when(p.contains("broken"), '{"score": "none"}').when(F.lit(attempt == 0), "{").otherwise('{"score": "1.5"}')
    got = {r.seq: r.eval for r in A.judge_answers(trace, judge, "w", "n").collect()}
    assert got[1].faithfulness == 0.5 and got[3] is None
    assert (got[2].faithfulness, got[2].unsupported, got[2].answer_relevancy, got[2].relevancy_reason, got[2].judge_vendor) == (1.0, [], 1.0, "", "w")
    assert A.models_of({"default": {"answer": "a"}, "x": {"answer": "b"}}, "answer") == "a" and A.models_of({"default": {}, "x": {"answer": "b"}}, "answer", local="l", vendor="x") == "l"


def test_json_ok_and_retries(spark):
    df = spark.createDataFrame([("{}",), ('x {"a": 1}',), ("no",), ("{ }",)], "t string")
    assert [r[0] for r in df.select(A.json_ok(F.col("t"))).collect()] == [False, True, False, False]
    naps, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

        return "ok"

    assert A.with_retries(flaky, sleep=naps.append)() == "ok" and naps == [2, 4]


def test_model_comparison_leaves_refusals_out(spark):
    rows = [("m", "v", "v", "a long enough answer", 0.5, 1.0), ("m", "v", "w", "근거를 찾지 못했습니다 이 질문에는", 0.0, 0.0), ("n", "w", "v", "a long enough answer", 1.0, None)]
    got = {r.model: r for r in A.compare_models(spark.createDataFrame(rows, "model string, vendor string, judge_vendor string, answer string, faithfulness double, relevancy double")).collect()}
    assert (got["m"].n, got["m"].refusals, got["m"].faithfulness, got["m"].own_judge) == (2, 1, 0.5, True) and got["n"].relevancy is None


def test_corpus_building(spark, tmp_path):
    docs = spark.createDataFrame([(1, "기업회계기준서 제1116호 리스", "1 첫 문단\n2 둘째 문단"), (2, "제2장 재무제표", "2.1 첫 문단"), (3, "개념체계", "1 무시")], "doc_id long, title string, text string")
    got = sorted((r.doc_id, r.record_type, r.ref_key, r.standard_no, r.standard_name) for r in C.standard_records(docs).collect())
    assert got == [(1, "paragraph", "제1116호 문단 1", "1116", "리스"), (1, "paragraph", "제1116호 문단 2", "1116", "리스"), (2, "paragraph", "제2장 문단 2.1", "제2장", "재무제표")]

    path = str(tmp_path / "c")
    made = []
    build = lambda: made.append(1) or spark.createDataFrame([("a", 1)], "collection string, x int")
    assert C.ensure_corpus(spark, path, build).count() == C.ensure_corpus(spark, path, build).count() == 1 and made == [1]

    rec = spark.createDataFrame([(1, None, None, "body_fallback", "old", "k"), (2, "q", "a", "html", None, "k")], "id long, question string, answer string, qa_source string, body string, keep string")
    raw = spark.createDataFrame([(1, "[질의]\n묻다\n[회신]\n답하다", None, None)], "id long, body string, att_text string, att_kind string")
    out = {r.id: r for r in C.reparsed(rec, raw, F.col("qa_source") == "body_fallback").collect()}
    assert (out[1].question, out[1].qa_source, out[1].body, out[1].keep) == ("묻다", "html", None, "k") and out[2].question == "q"

    old = spark.createDataFrame([(1, "term", "t", [1.0], 1), (2, "paragraph", "p", [1.0], 1)], "id long, record_type string, text string, vec array<float>, version int")
    new = spark.createDataFrame([(1, "term", "longer"), (2, "paragraph", "ignored")], "id long, record_type string, text string")
    one = lambda t: F.array(F.length(t).cast("float"))
    got = {r.id: (r.text, list(r.vec)) for r in C.reembedded(old, new, F.col("text"), one).collect()}
    assert got == {1: ("longer", [6.0]), 2: ("p", [1.0])}
    assert [r.id for r in C.embedded(spark.createDataFrame([(2, "x"), (3, " "), (4, "y")], "id long, text string"), F.col("text"), one, old).collect()] == [4]
    js, md = C.report(spark.createDataFrame([("ALL", 0.5)], "scope string, exact double"), "T")
    assert js == '[{"scope": "ALL", "exact": 0.5}]' and "| ALL | 0.5 |" in md
    assert C.converted(spark.createDataFrame([("c", "t", 1)], "case_id string, title string, other int")).columns == ["record_type", "case_id", "title"]


def test_standard_rows(spark):
    row = """<tr><td><a onclick="fn_Detail('3001','{}')"><b>T</b></a></td><td><a onclick="fileDownload('-1','2')">a.hwp</a><a onclick="fileDownload('3','4')"></a></td></tr>"""
    got = html.standard_rows(spark.createDataFrame([(row.format(7) + row.format(8).replace("3001", "3003"),)], "html string"), "3001").collect()
    assert [(r.seq, r.title, [tuple(a) for a in r.attachments]) for r in got] == [("7", "T", [("-1", "2", "a.hwp")])]
