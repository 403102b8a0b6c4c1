"""The transducer, units and encoding against the tokenizers library."""

import hashlib
import json
import random
import struct

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import lexicon
from folioscope.llm.spans import column_bytes

PATH = public.path("word_bpe_49k.json")
ODD = ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "IT'S.", "é.", "“x”", "á", "À", "#.", "x#.", "9,9.", "\x1c", "\x85", "İ.", "İ", "Σ", "ΟΔΟΣ.", "日本.", "🙂!", "...", "'S.", "\x00", "ﬁ.", "½.", " ", "  ", "\n", "\xa0"]
ODD += ["The", "of,", "'", "''s", "'ll", "LLama", ",'s", "a'", "1st", "<|", "|>", "́", "　", "x" * 300, *"ab'. ,1<|"]


@pytest.fixture(scope="module")
def merges():
    return lexicon._merges(PATH)


def same_ids(merges, texts, words, most=50):
    words = sorted(set(words) - {b""})
    enc = lexicon.Encoder(lexicon.Lexicon(lexicon.Lexicon.compile(words, [merges.of(w) for w in words])), merges, most)
    ids, at = enc.ids(*column_bytes(pa.array(texts)))
    for t, a, b in zip(texts, at, at[1:], strict=False):
        assert ids[a:b].tolist() == merges.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def some_units(texts, share, seed=0):
    r = random.Random(seed)
    raw, starts, ends, special = lexicon.units(*column_bytes(pa.array(texts)))
    return [raw[s:e].tobytes() for s, e, x in zip(starts, ends, special, strict=True) if not x and r.random() < share]


@pytest.mark.parametrize("share", [0, 0.5, 1])
def test_ids_equal_the_library(merges, share):
    r = random.Random(4)
    texts = [None, "", *("".join(r.choice(ODD) for _ in range(30)) for _ in range(1500))]
    same_ids(merges, texts, some_units(texts, share))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=6))
def test_ids_of_any_text(texts):
    m = lexicon._merges(PATH)
    same_ids(m, texts, some_units(texts, 0.5), most=3)


def test_long_and_short_merges_agree(merges):
    r = random.Random(1)
    for _ in range(200):
        word = "".join(r.choice("aabbcdeinotsr") for _ in range(r.randrange(1, 90)))
        assert merges.piece(list(word)) == merges.pieces(list(word)) == merges.tokenizer.encode(word, add_special_tokens=False).ids
    same_ids(merges, ["ab" * 50_000, "é" * 20_000], [])


def test_automaton_is_minimal_and_finds_words_alone():
    r = random.Random(2)
    words = sorted({bytes(r.choice(b"abc\xff\x00") for _ in range(r.randrange(1, 7))) for _ in range(900)} | {b"aaaa" + s for s in (b"ing", b"ed", b"s")})
    arcs, final, first = lexicon.minimal_automaton(words)
    futures = {}

    def future(s):
        if s not in futures:
            futures[s] = frozenset(([b""] if final[s] else []) + [bytes([b]) + f for b, t in arcs[s] for f in future(t)])
        return futures[s]

    assert future(first) == frozenset(words)
    assert len({future(s) for s in range(len(arcs))}) == len(arcs)  # no two states with one future
    lex = lexicon.Lexicon(lexicon.Lexicon.compile(words, [np.arange(i % 3, dtype=np.uint32) for i in range(len(words))]))
    asked = words + [w + b"a" for w in words] + [w[:-1] for w in words] + [b"zz", b"\x00"]
    raw, rows = column_bytes(pa.array(asked, pa.binary()))
    got = lex.places(raw, rows[:-1], np.diff(rows))
    where = {w: i for i, w in enumerate(words)}
    assert got.tolist() == [where.get(w, -1) for w in asked]
    assert lexicon.Lexicon(lexicon.Lexicon.compile([], [])).places(raw, rows[:-1], np.diff(rows)).max() == -1


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="whole texts"):
        lexicon.Merges(public.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="whole texts"):
        lexicon.Merges(str(tmp_path / "t.json"))


def digests(merges, rows):
    out = []
    for i, text in rows:
        ids = merges.tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(merges.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_the_library(spark, merges):
    data = "/root/testdata/sf0.001"
    want = digests(merges, [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()])
    assert sorted(map(tuple, lexicon.op13_bpe(spark, data).collect()), key=repr) == want


def test_odd_documents_and_none(spark, merges, odd_docs, no_docs, tmp_path):
    for docs in (odd_docs, no_docs):
        uri = lexicon.write_lexicon(docs, PATH, most=20)
        both = lexicon.decode_bpe(lexicon.encode_bpe(docs, PATH, uri), PATH)
        got = both.selectExpr("doc_id", "cast(length(ids) / 4 as long)", "sha2(ids, 256)", "sha2(cast(decoded as binary), 256)")
        assert sorted(map(tuple, got.collect()), key=repr) == digests(merges, [(r.doc_id, r.text) for r in docs.collect()])


def test_frequent_units_are_those_of_the_highest_counts(spark):
    docs = spark.createDataFrame([("a a a a b b b c c d. A",), (None,), ("b b b b b b c",)], "text string")
    assert lexicon.frequent_units(docs, 2) == [b"a", b"b"]
    assert lexicon.frequent_units(docs, 100) == [b"a", b"b", b"c"]
    assert lexicon.frequent_units(docs.limit(0)) == []
