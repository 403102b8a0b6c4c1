"""Near duplicates among rows that share a doc_id or have none."""

import pyarrow as pa

import corpus_pipeline
from folioscope.llm import minhash

A, B, C = (" ".join(f"{c}{i}" for i in range(120)) for c in "abc")
ROWS = [(None, A), (None, None), (None, ""), (None, A + " tail"), (None, B), (5, A + " end"), (6, C), (6, B + " end"), (7, C + " end"), (8, "alone here and never linked"), (None, B)]


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = minhash.near_duplicates(docs, k=4, block=150).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_key, r.component) for r in got} == {(minhash.NULL_ID, minhash.NULL_ID), *((i, minhash.NULL_ID) for i in (5, 6, 7)), (8, 8)}
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    texts = [t for i, t in kept if i is None and t]
    assert len(texts) == 2 and B in texts and (A in texts) + (A + " tail" in texts) == 1
    assert {x for x in kept if not x[1] or x[0] is not None} == {(None, None), (None, ""), (8, "alone here and never linked")}


def test_an_empty_set_at_the_end_of_a_tile():
    rows = {"cluster": [1] * 4, "tile": [0] * 4, "doc": [1, 2, 3, 4], "text": [x.encode() for x in (A, A + " end", A + " tail", " ")]}
    b = pa.RecordBatch.from_arrays([pa.array(v) for v in rows.values()], list(rows))
    links = [x for r in minhash._exact_links([b], 4, 80) for x in zip(r["a"].to_pylist(), r["b"].to_pylist())]
    assert sorted(links) == [(2, 1), (3, 1)]
