"""JSON-lines collections, pages, binary documents, boards, and records."""

import json

from pyspark.sql import functions as F

from folioscope.operators import records as R
from folioscope.sources import boards, documents, html, jsonl


def test_collections_number_all_lines_and_skip_missing_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"ref_key": "K", "text": "t"}) + "\n\n" + json.dumps({"question": "q", "standard_refs": ["r"]}) + "\nbroken\n")
    got = jsonl.read_collections(spark, str(tmp_path), {"qa": ["a.jsonl", "none.jsonl"]}).orderBy("lineno").collect()
    assert [(r.collection, r.id, r._corrupt, r.ref_key, r.question) for r in got] == [("qa", "a:0", False, "K", None), ("qa", "a:2", False, None, "q"), ("qa", "a:3", True, None, None)]
    assert jsonl.read_collections(spark, str(tmp_path), {"qa": ["none.jsonl"]}).count() == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f"line {i} {'x' * (i % 97)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = jsonl.numbered_lines(spark, str(tmp_path / "big.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r.value.startswith(f"line {r.lineno} ") for r in rows)


def test_write_and_rebuild(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "collection string, x int")
    jsonl.write_collections(df, str(tmp_path / "j"))
    jsonl.write_collections(df.where("x = 1"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    jsonl.rebuild_collections(df, str(tmp_path / "p"))
    jsonl.rebuild_collections(df.where("x = 1").withColumn("x", F.lit(9)), str(tmp_path / "p"))
    assert sorted((r.collection, r.x) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("a", 9), ("b", 2)]
    jsonl.dead_letters(spark.createDataFrame([("t", "b", "1", "s", "e")], "ts string, board string, seq string, stage string, err string"), str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first()[0] == "t\tb\t1\ts\te"


def test_pages(spark):
    page = """<div class="board_view_wrap"><table><tr><th>회신일자</th><td>2025-01-02</td></tr></table></div><a onclick="fileDownload('1','2')">f.hwp</a>
    <div class="board_view_cont x"><p>첫 줄이 길게 이어지고 더 이어진다</p><div>둘째 줄</div> ‘신속처리질의’는 면책</div>"""
    d = html.parse_detail(page)
    assert d["meta"] == {"회신일자": "2025-01-02"} and d["attachments"] == [{"file_no": "1", "file_seq": "2", "name": "f.hwp"}]
    assert d["body"] == "첫 줄이 길게 이어지고 더 이어진다\n둘째 줄"
    assert html.parse_detail("<div class='board_view_cont'>aaaaaaaaaaaa\nEND tail</div>", ("^END",))["body"] == "aaaaaaaaaaaa"
    assert html.to_text("<p>a  b</p><table><tr><td>x</td><td><table><tr><td>in</td></tr></table></td></tr><tr><td></td></tr></table>c") == "a b\nx |\nin\nc"
    assert html.to_text(None) == ""
    row = """<tr><td>1</td><td><a onclick="fn_Detail('7','{}')">T</a></td></tr>"""
    df = spark.createDataFrame([(row.format("16") + row.format("17"),), (None,)], "html string")
    assert [tuple(r) for r in html.list_rows(df, "16").collect()] == [("7", "T", "", "")]
    assert [tuple(r) for r in html.list_rows(df, "7", order=(2, 1)).collect()] == [("16", "T", "", ""), ("17", "T", "", "")]
    assert html.details(spark.createDataFrame([(1, page)], "page_id long, html string")).first().body.endswith("둘째 줄")


def test_documents_fall_back(spark, tmp_path):
    def broken(content):
        raise ValueError("no tool")

    documents.register_extractor(".hwp", broken)
    documents.register_extractor(".pdf", lambda c: c.decode())
    for name, text in (("a.hwp", "x"), ("a.pdf", "from pdf"), ("b.hwp", "x"), ("c.txt", "ignored")):
        (tmp_path / name).write_text(text)
    got = {r.name: (r.text, r.kind, r.error) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": ("from pdf", ".pdf", None), "b": (None, None, ".hwp: ValueError('no tool')")}


def test_board_source(spark):
    naps = []
    get = boards.polite(lambda p: f"page {p}", sleep=naps.append)
    assert [get(1), get(2), get(3)] == ["page 1", "page 2", "page 3"] and len(naps) == 2 and all(1 <= n <= 2 for n in naps)
    boards.register_client("fake", lambda board: lambda page: f"{board}-{page}")
    boards_polite, boards.polite = boards.polite, lambda fetch: fetch
    try:
        spark.dataSource.register(boards.BoardSource)
        reader = boards.BoardSource({"client": "fake", "board": "x", "pages": "3", "pages_per_task": "2"}).reader(None)
        assert [p.value for p in reader.partitions()] == [(1, 2), (3, 3)]
        assert list(reader.read(reader.partitions()[1])) == [(3, "x-3")]
    finally:
        boards.polite = boards_polite


def test_records(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, version long, v string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 2, "d")], "id long, version long, v string")
    assert sorted(tuple(r) for r in R.upsert(old, new).collect()) == [(1, 1, "a"), (2, 2, "c"), (3, 2, "d")]
    assert [r.id for r in R.only_new(new, old).collect()] == [3]
    assert spark.range(1).select(R.record_id(F.lit("x.jsonl"), F.lit(4))).first()[0] == "x:4"
