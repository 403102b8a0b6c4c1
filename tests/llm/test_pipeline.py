"""The pipeline's stages on a small table, stage by stage against what each promises."""

from collections import Counter

import corpus_pipeline as cp
from folioscope.llm import decontam

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "token_ids" or docs.columns == names
        kept[name] = docs.collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    good = {d for d, r in labels.items() if r.quality == 1}
    assert len(good - ids["quality"]) <= 0.03 * len(good) and len(ids["quality"] & set(labels) - good) <= 0.5 * (len(labels) - len(good))
    assert ids["near_dedup"] <= ids["quality"] and ids["decontamination"] <= ids["near_dedup"]
    assert not any(n > 1 for n in Counter(r.text for r in kept["near_dedup"]).values())
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontam.overlaps(spark.read.parquet(str(tmp_path / "decontamination")), bench).count() == 0
    whole = {r.doc_id: r.text for r in kept["decontamination"]}
    assert all(whole[r.doc_id].startswith(r.text) for r in kept["mixing"])
    assert Counter(r.doc_id for r in kept["token_ids"]) == Counter(r.doc_id for r in kept["mixing"])
    assert sorted(map(tuple, cp.run(spark, DATA).collect())) == sorted(map(tuple, kept["token_ids"]))


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for k, stage in cp.STAGES:
            out = stage(spark, docs, DATA)
            assert k == "token_ids" or out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / k))
            assert name == "odd" or spark.read.parquet(str(tmp_path / name / k)).count() == 0


def test_rows_of_one_id_give_equal_rows_in_any_order(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} {i} " * 3, f"s{i % 2}", "en", 1) for i in range(6)] + [(2, f"{text} 2 " * 3, s, l, n) for s, l, n in (("s1", "en", 1), (None, "de", 2), ("s1", None, 1), ("s0", "en", 0))]
    # texts of one size under one id, of which the mix may cut one
    rows += [(9, " ".join(f"{c}{i}" for i in range(90)), "s2", "en", 1) for c in "abcdefg"]
    found = []
    for parts in (1, 7):
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame(order, "doc_id long, text string, source string, lang string, n_chars long").repartition(parts)
            kept = cp.near_dedup(spark, docs, DATA)
            found.append((sorted(map(repr, kept.collect())), sorted(map(repr, cp.mixing(spark, docs, DATA).collect()))))
    assert all(f == found[0] for f in found)
    # one group of near copies under ids 0 to 5 and 2 again; under id 9 nothing is a copy
    assert len(found[0][0]) == 8
