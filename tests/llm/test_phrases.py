"""Phrase collocations against counting every phrase of every piece, and the suffix automaton's states by their definition."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from folioscope.llm import phrases
from folioscope.llm.spans import column_bytes, span_hashes, spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, depth=4, least=30, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in kept.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in kept.items():
            if 100 * inside[p] < share * a:
                score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["The", "the", "a", "of", "é", "x.y", "a.", "b,c", "|", "to", "\x00", "New", "York", "\x1c"]
    for _ in range(n):
        yield r.choice(["en", "fr", None, "und"]), r.choice([None, "", *("".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", "\n"]) for _ in range(r.randrange(60))) for _ in range(20))])


@pytest.mark.parametrize("shard,bits", [(40, 3), (40, 10), (1 << 22, 27)])
def test_rows_equal_counting_everything(spark, shard, bits):
    rows = list(texts(3, 300))
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], "lang string, text string, key string, n int").repartition(3)
    got = phrases.collocations(docs, least=4, top=60, most_words=shard, map_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least=4, top=60)


def test_odd_documents_and_none(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, phrases.collocations(odd_docs, least=2).collect())) == brute(rows, least=2)
    assert phrases.collocations(no_docs).collect() == []


def test_counts_past_64_bits(spark):
    """Scores come from products of over 64 bits."""
    score = spark.sql(f"select {phrases._SCORE} as s from values (9000000000000000000, 9000000000000000000, 9000000000000000000) t(a, l, r)")
    assert score.first().s == 1000000


def test_words_of_one_hash_are_noticed(spark):
    rows = [(b"12345678", "en", b"a", 40), (b"12345678", "en", b"b", 1), (b"22345678", "en", b"c", 40), (b"", "en", None, 90), (b"", "fr", None, 90), (b"1234567822345678", None, None, 30)]
    counted = spark.createDataFrame(rows, "key binary, lang string, word binary, n long")
    assert [bytes(r.key) for r in phrases._shared_hashes(counted).collect()] == [b"12345678"]
    assert phrases._shared_hashes(counted.where("n > 1")).collect() == []


def test_states_share_their_end_positions():
    r = random.Random(5)
    for _ in range(40):
        words = np.array([r.randrange(4) for _ in range(r.randrange(1, 60))])
        reach = np.array([min(i + 1, r.choice([1, 2, 3, 4, 4, 4])) for i in range(len(words))])
        ends = defaultdict(set)
        for i in range(len(words)):
            for d in range(1, reach[i] + 1):
                ends[tuple(words[i - d + 1 : i + 1])].add(i)
        tree = phrases.SuffixAutomaton(words, reach, 4)
        found = {}
        for d, level in enumerate(tree.levels, 1):
            for s in tree.states(d):
                p = tuple(words[level["end"][s] - d + 1 : level["end"][s] + 1])
                for m in range(level["shortest"][s], d + 1):
                    assert p[d - m :] not in found
                    found[p[d - m :]] = level["count"][s]
        assert found == {p: len(e) for p, e in ends.items()}


def test_hashes_do_not_depend_on_slices():
    raw, rows = column_bytes(__import__("pyarrow").array(["one two  one", None, "", "two o" + "x" * 300, "one"]))
    starts, ends = spans(raw != 0x20, rows[:-1][rows[:-1] < len(raw)])
    whole = span_hashes(raw, starts, ends)
    assert (whole == span_hashes(raw, starts, ends, slice_bytes=4)).all()
    words = [raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert words == [b"one", b"two", b"one", b"two", b"o" + b"x" * 300, b"one"]
    assert len(set(whole.tolist())) == len(set(words))


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.sql(phrases.OP11_SQL)
    got = phrases.op11_collocations(spark, data).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []


def test_keys_are_grouped_as_by_unique():
    r = np.random.default_rng(4)
    for below in (1, 7, 1 << 20, 1 << 60):  # the last does not fit beside its place
        for n in (0, 1, 500):
            keys = r.integers(0, below, n)
            want = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)[1:]
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(phrases._grouped(keys.copy(), below), want, strict=True))


def test_slices_do_not_change_counts(monkeypatch):
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"lang": [x or "und" for x, _ in texts(8, 200)], "text": [(t or "").encode() for _, t in texts(8, 200)]})
    bits = np.random.default_rng(1).integers(0, 256, 1 << 13, np.uint8) | np.uint8(0x77)
    shared = type("Shared", (), {"value": bits})

    def found():
        whole = [x for r in (phrases._upper_counts([b], 0, 1 << 22, None), phrases._upper_counts([b], 0, 1 << 22, shared), phrases._exact_counts([b], 0, 1 << 22, 4, shared)) for x in r]
        return sorted(repr(row) for x in whole for row in x.to_pylist())

    want = found()
    monkeypatch.setattr(phrases, "STEP", 5)
    assert found() == want


def test_a_shard_takes_little_memory_a_word():
    """Texts are not held until the shard is counted; 238 bytes a word were taken before."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(2)
    vocabulary = np.array([f"word{i}" for i in range(3000)])
    n = 1_500_000
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 15, "text": [" ".join(vocabulary[r.zipf(1.3, n // 300) % 3000]).encode() for _ in range(15)]}) for _ in range(20)]
    shared = type("Shared", (), {"value": np.full(1 << 13, 255, np.uint8)})
    tracemalloc.start()
    for _ in phrases._exact_counts(iter(batches), 0, n, 4, shared):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * n


def test_a_shard_sends_a_phrase_in_one_pass_with_its_exact_count():
    """Words, pairs and triples were sent by each shard a second time, once frequent."""
    import pyarrow as pa

    rows = [(x or "und", t or "") for x, t in texts(11, 200)]
    b = pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows], "text": [t.encode() for _, t in rows]})
    shared = type("Shared", (), {"value": np.full(1 << 13, 255, np.uint8)})
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4, 5) for i in range(len(w) - k + 1))
    passes = [[x for r in found for x in r.to_pylist()] for found in (phrases._upper_counts([b], 0, 1 << 22, None), phrases._upper_counts([b], 0, 1 << 22, shared), phrases._exact_counts([b], 0, 1 << 22, 5, shared))]
    assert [{len(r["key"]) // 8 for r in p} for p in passes] == [{0, 1, 2}, {3}, {4, 5}]
    sent = [r for p in passes for r in p if r["key"]]
    names = {r["key"]: (r["lang"], r["word"].decode()) for r in sent if r["word"] is not None}
    spelled = [[names[r["key"][i : i + 8]] for i in range(0, len(r["key"]), 8)] for r in sent]
    got = Counter({(s[0][0], *(w for _, w in s)): r["n"] for s, r in zip(spelled, sent, strict=True)})
    assert len(sent) == len(got) and got == want


def test_a_shard_shorter_than_the_longest_phrase():
    assert list(phrases._long_counts(np.array([5, 6], np.uint64), np.array([1, 2], np.int8), 4, 4)) == []
