"""The stored index against BM25 over the texts, and the blocks that it need not score."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext

from folioscope.operators import lexical_index as L
from folioscope.operators import retrieval as R
from folioscope.operators.shared import shared_folder


def rows(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 7)) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(6)
    word = lambda: f"w{min(int(r.paretovariate(0.6)), 300)}"
    docs = [(i, " ".join(word() for _ in range(r.randrange(40)))) for i in range(400)] + [(400, None), (401, ""), (402, "w1 " * 5000)]
    asked = [(q, " ".join(word() for _ in range(r.randrange(1, 9)))) for q in range(25)] + [(25, "nothing known"), (26, ""), (27, None), (28, "w1 w1 w2")]
    return spark.createDataFrame(asked, "qid long, qtext string"), spark.createDataFrame(docs, "id long, text string").repartition(5)


@pytest.mark.parametrize("block,k", [(1024, 5), (10, 5), (1, 1), (50, 40)])
def test_rows_equal_scoring_all_texts(spark, texts, block, k):
    q, docs = texts
    index = L.build_postings(docs, shared_folder(spark, "t"), block=block)
    want = rows(R.bm25_topk(q, docs, k))
    assert rows(L.postings_topk(q, index, k)) == want
    assert rows(L.postings_topk(q, L.LexicalIndex(index.folder), k, most=4)) == want


def test_a_part_is_read_by_one_task_and_terms_are_pushed_down(spark, texts):
    q, docs = texts
    index = L.build_postings(docs, shared_folder(spark, "t"), block=10)
    import glob

    import pyarrow.parquet as pq

    files = glob.glob(index.folder.removeprefix("file://") + "/postings/*.parquet")
    assert len(files) == 5 and all(len(set(pq.read_table(f)["part"].to_pylist())) == 1 for f in files)
    assert all(pq.ParquetFile(f).metadata.num_row_groups == 1 for f in files)
    plan = L.postings_topk(q.where("qid = 28"), index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w1,w2])]" in plan
    assert "Exchange hashpartitioning(term" not in plan and "Exchange hashpartitioning(part" not in plan


def test_blocks_below_the_kth_score_are_skipped():
    low = {"a": (1.0, np.array([5, 6]), np.array([1.0, 0.5]))}
    high = {"a": (9.0, np.array([1, 2]), np.array([9.0, 8.0])), "b": (1.0, np.array([2]), np.array([1.0]))}
    best = L._Best(2)
    assert L._score_part({0: low, 1: high}, [{"a": 1.0, "b": 2.0}], {"a": [0], "b": [0]}, best) == 1
    assert best.of[0] == [(-10.0, 2), (-9.0, 1)]


def test_no_documents_and_no_questions(spark, texts):
    q, docs = texts
    index = L.build_postings(docs.where("false"), shared_folder(spark, "t"))
    assert rows(L.postings_topk(q, L.LexicalIndex(index.folder), 3)) == []
    assert rows(L.postings_topk(q.where("false"), L.build_postings(docs, shared_folder(spark, "t")), 3)) == []


def test_a_search_holds_one_run_at_a_time(spark, texts, monkeypatch):
    q, docs = texts
    words = docs.where("id < 400").coalesce(1).select("id", L.tokens("text").alias("w"))
    batch = pa.Table.from_batches(words.toArrow().to_batches()).combine_chunks().to_batches()[0]
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    built = pa.Table.from_batches(L._postings([batch], lambda tf, dl: tf.astype(float), 10))
    held = []
    monkeypatch.setattr(L, "_score_part", lambda lists, *_: held.append(set(lists)))
    asked = [{t: 1.0 for t in set(built["term"].to_pylist())}]
    rows = built.sort_by([(c, "ascending") for c in ("run", "term", "block") if c in built.column_names]).to_batches()
    assert not list(L._search(rows, type("Sent", (), {"value": ([1], asked)})(), 3))[0].num_rows
    blocks = [b for b in held if b]
    assert sorted(x for b in blocks for x in b) == list(range(40)) and max(map(len, blocks)) == L.RUN_BLOCKS
    monkeypatch.setattr(L, "RUN_WORDS", 1)
    few = pa.Table.from_batches(L._postings([batch], lambda tf, dl: tf.astype(float), 10))
    assert few["run"].to_pylist() == few["block"].to_pylist()
