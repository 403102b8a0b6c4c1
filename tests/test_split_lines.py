"""Paragraphs from blocks of lines against reading documents from first line to last."""

import random

from pyspark.sql import functions as F

from folioscope.operators import split as S
from folioscope.operators import split_lines as L
from folioscope.plans import QUERIES

_ROW = ("doc_id", "ref_key", "para_no", "series", "section", "text")


def random_text(r, n):
    """Lines that open, repeat, jump too far, begin sub-items or only look as if."""
    out, last = [], {"": (1, 1), "B": (1, 1), "BC": (3, 1)}
    for _ in range(n):
        k, series = r.random(), r.choice(["", "", "B", "BC"])
        if k < 0.45:
            lead, minor = last[series]
            jump = r.choice([0] * 40 + [1, 2, 30, 60, -3])
            last[series] = (lead % 900 + max(jump, -lead), 1) if jump else (lead, max(minor + r.choice([0, 0, 1, 1, 2, -2]), 0) if minor < 900 else 1)
            lead, minor = last[series]
            no = f"{lead}" + r.choice([f".{minor}"] * 9 + ["", f".{minor}.1"])
            out.append(f"{series}{no}{r.choice(['', '', '', 'A', 'B', 'ZA'])}{r.choice([' ', ' ', ''])}{r.choice(['문단', '개월', '| 표', 'words', '[제목]'])} {r.randint(0, 9)}")
        elif k < 0.7:
            out.append(f"{r.choice('⑴⑵⑶⑷⑸')}{r.choice(['', ' 항목'])}")
        elif k < 0.73:
            out.append(r.choice(["적용사례", "부록 B", "결론도출근거 문단"]))
        else:
            out.append(r.choice(["이어지는 줄", "", "  ", "\x0b뒤 줄 ", "words"]))
    return "\n".join(out)


def test_summaries_say_what_reading_says():
    r = random.Random(3)
    for _ in range(300):
        series = r.choice(["", "B"])
        number = lambda: "".join(f"{r.choice([1, 2, 3, 30, 52, 53, 100, 140]):03d}" for _ in range(r.randint(1, 2)))  # noqa: B023, E731
        block = [(number(), r.choice(["", "", "A"])) for _ in range(r.randint(1, 12))]
        found = L.summary(series, block)
        for entry in (None, *(number() for _ in range(8))):
            state = entry
            for num, suffix in block:
                state = L.step(state, series, num, suffix)
            assert L.after(entry, *found) == state


def test_lines_equal_whole_documents(spark):
    r = random.Random(7)
    texts = [random_text(r, n) for n in (0, 1, 5, *[60] * 20, 300, 300, 900, 2500)] + [None, "글만 있다"]
    docs = spark.createDataFrame([(i, t, str(1000 + i)) for i, t in enumerate(texts)], "doc_id long, text string, number string")
    want = [(i, *(p[c] for c in _ROW[1:])) for i, t in enumerate(texts) for p in S.split_standard(t, str(1000 + i))]
    assert len(want) > 300 and {x[3] for x in want} == {"본문", "B", "BC"}
    for block, in_order in ((7, False), (100, True), (4096, True)):
        rows = L.split_lines(L.lines_of(docs), block, in_order).orderBy("doc_id", "n").select(*_ROW).collect()
        assert [tuple(x) for x in rows] == want, block


def test_query_equals_whole_documents(spark):
    whole, lines = (QUERIES[q](spark, "/root/testdata/sf0.001").select(*_ROW) for q in ("split_paragraphs", "split_paragraph_lines"))
    assert whole.count() == lines.count() and whole.exceptAll(lines).isEmpty()


def test_odd_lines(spark):
    schema = "doc_id long, number string, n int, line string"
    assert L.split_lines(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "1", 3, "1 첫 문단"), (1, "1", 90, None), (1, "1", 5000, "2 다음 문단"), (None, "1", 0, "1 누구의 것도 아닌 문단")]
    assert [(x.n, x.para_no) for x in L.split_lines(spark.createDataFrame(rows, schema)).orderBy("n").collect()] == [(3, "1"), (5000, "2")]


def test_one_long_document_lies_over_many_tasks(spark):
    lines = spark.range(200_000).select(
        F.lit(1).alias("doc_id"), F.lit("1").alias("number"), F.col("id").alias("n"),
        F.when(F.col("id") % 4 == 0, F.concat((1 + F.floor(F.col("id") / 3600)).cast("string"), F.lit("."), (1 + F.floor(F.col("id") / 4) % 900).cast("string"), F.lit(" 문단"))).otherwise(F.lit("⑴ 항목")).alias("line"),
    )
    out = L.split_lines(lines)
    got = out.agg(F.count("*").alias("n"), F.count_distinct("para_no").alias("d"), F.count_if(F.col("text") == "문단\n⑴ 항목\n⑴ 항목\n⑴ 항목").alias("whole")).first()
    assert (got.n, got.d, got.whole) == (100_000, 100_000, 50_000)
