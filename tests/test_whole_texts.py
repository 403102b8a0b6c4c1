"""Splitting queries run over whole documents, not over their beginnings."""

import re

from folioscope import plans

LONG = " ".join(f"Sentence {i} has a | bar, a colon: {i * 7}." for i in range(60))
TEXTS = {1: LONG, 2: "3 한글 줄\n부록 A\nx: y\n\n" + LONG + "\n용어의 정의는 다음과 같다.\n4 끝", 3: None, 4: "one line", 5: "\n".join(f"line {i}" for i in range(4000)), 6: "“따옴표” 그리고 " + "가나다 " * 100}
GOES_ON = "앞의 용어에 덧붙이는 설명이며 새로운 용어를 정하지 아니하는 줄이다 그 내용은"


def _saved(spark, folder):
    spark.createDataFrame([(i, "en", "web", t) for i, t in TEXTS.items()], "doc_id long, lang string, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _pieces(text):
    plain = (text or "").translate(str.maketrans("“”", "''"))
    return [x.rstrip() for line in plain.split("\n") for x in re.split(r"(?<=[.!?。])(?=\s)", line)]


def test_split_paragraphs_of_whole_texts(spark, tmp_path):
    got = {}
    for r in plans.QUERIES["split_paragraphs"](spark, _saved(spark, tmp_path)).collect():
        got.setdefault(r.doc_id, {})[r.para_no] = r.text
    for doc, text in TEXTS.items():
        want = {}
        p = _pieces(text)
        for j in range(0, len(p), 4):
            no, four = f"{2 + j // 3600}.{1 + j // 4 % 900}", p[j : j + 4]
            second = "\n".join([*(x.lstrip() for x in four[2:3]), *(f"또한 {x}".strip() for x in four[3:])]).strip()
            items = {"⑴": four[1].lstrip() if len(four) > 1 else None, "⑵": second if len(four) > 2 else None}
            items = {k: v for k, v in items.items() if v is not None}
            want[no] = "\n".join([f"이 문단은 {four[0]}".strip(), *(f"{k} {v}" for k, v in items.items())])
            want |= {no + k: v for k, v in items.items()}
        assert {k: v for k, v in got[doc].items() if re.match(r"\d+\.", k)} == want
        assert {"1", "1⑴", "1⑵", "1A", "B1", "BC1"} == {k for k in got[doc] if not re.match(r"\d+\.", k)}


def test_split_terms_of_whole_texts(spark, tmp_path):
    got = {}
    for r in plans.QUERIES["split_terms"](spark, _saved(spark, tmp_path)).collect():
        got.setdefault(r.doc_id, {})[r.term] = r.text
    for doc, text in TEXTS.items():
        want, p = {}, _pieces(text)
        for i, x in enumerate(p):
            if i % 3 < 2:
                want[last := f"용어 {i}"] = f"뜻 {x}".strip()
            else:
                want[last] += f" {GOES_ON} {x}".rstrip()
        assert got[doc] == want


def test_split_qa_reads_the_whole_text(spark, tmp_path, monkeypatch):
    from folioscope.plans import records

    seen = []
    monkeypatch.setattr(records.S, "split_documents", lambda docs, kind: seen.append(docs) or docs.selectExpr("doc_id", "text as question", "text as answer", "text as related"))
    plans.QUERIES["split_qa"](spark, _saved(spark, tmp_path))
    assert all((TEXTS[r.doc_id] or "") in r.text for r in seen[0].collect())
