"""Chat formatting and mixing against plain Python and SQL."""

import glob
import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, mixing, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_chats_come_back_whatever_they_say(spark):
    r = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_next|>", "\\", "<", "|", "<\\|", "\\\\", "\n", "x", "<|", "~", "<\\~", "ü", "assistant"]
    say = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
    rows = []
    for c in range(120):
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "system", None, "a\n" + say()]), r.choice([say(), None])))
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id long, turn long, role string, text string, segments string, t int")
    key = lambda x: ((x[1] is not None, x[1] or 0), x[2] or "", x[3] or "")
    got = {x.conv_id: x for x in chat.format_chats(df).withColumn("turns", chat.parse_chat(F.col("formatted"))).collect()}
    for c in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=key)]
        g = got[c]
        assert [(t.role, t.text) for t in g.turns] == turns
        assert "".join(s.text for s in g.segments) == g.formatted
        loss = "".join(s.text for s in g.segments if s.loss).replace("<\\|", "<|").replace("\\\\", "\\")
        assert loss == "".join(t for role, t in turns if role == "assistant")
        assert g.formatted.count(chat.START) == sum(i == 0 or turns[i - 1][0] != role for i, (role, _) in enumerate(turns))
    assert chat.format_chats(df.where("false")).count() == 0


def test_conversation_minus_one(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    r = chat.op6_chat_formatting(spark, DATA).where("conv_id = -1").first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(odd), hashlib.sha256(odd.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()


def filled(sizes, weights, epochs):
    """Water-filling by rounds."""
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] >= epochs * sizes[s] * w}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= epochs * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_mix(spark, seed):
    r = random.Random(seed)
    sources = [None, "a", "B", "é", "zz", "b"][: r.randint(1, 6)]
    scale = {s: r.choice([1, 3, 60]) for s in sources}
    rows = [(i, r.choice(sources), r.randint(0, 30) * 1) for i in range(400)]
    rows = [(i, s, n * scale[s]) for i, s, n in rows]
    names = ("words", "first", "before", "whole", "src", "src_", "h_", "range_", "c0_")
    df = spark.createDataFrame([(*x, "k", 9, *names) for x in rows], "doc_id long, source string, n long, target string, rest int" + "".join(f", {c} string" for c in names))
    out = mixing.take(df, F.col("n")).collect()
    assert len(out) == len(rows) and all(x["rest"] == 9 and all(x[c] == c for c in names) for x in out)
    order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in order}
    want = filled(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    for s in order:
        mine = [x for x in out if x.source == s]
        assert all(x.target == pytest.approx(want[s]) and x.source_size == sizes[s] for x in mine)
        assert sum(x.taken for x in mine) == int(mine[0].target + 0.5)
        assert all(0 <= x.taken <= 3 * x["size"] for x in mine)
        assert sum(x.taken % max(x["size"], 1) > 0 for x in mine) <= 1  # one document of a source is taken in part
    again = mixing.take(df.repartition(7), F.col("n")).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mix_of_odd_rows(odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    rows = out.collect()
    assert rows and all((r.doc_id, r.text) in texts or any(d == r.doc_id and t and t.startswith(r.text) and r.n_chars == len(r.text) for d, t in texts) for r in rows)
    assert mixing.mixed_documents(no_docs).count() == 0 and mixing.take(no_docs, F.lit(1)).count() == 0


def test_cut_keeps_white_space(spark):
    df = spark.createDataFrame([("a  b\n c d ", k) for k in (1, 2, 3, 4)] + [(" \ta b", 1), (" \ta b", 2)], "t string, k int")
    assert [r[0] for r in df.select(mixing.cut(F.col("t"), F.col("k"))).collect()] == ["a", "a  b", "a  b\n c", "a  b\n c d", " \ta", " \ta b"]
