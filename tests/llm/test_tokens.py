"""Token counts, the boundary code and token files against direct encoding."""

import base64
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import tokens
from folioscope.llm.base import shared_folder

WORDS = public.path("word_bpe_49k.json")
RANKS = public.path("byte_bpe_50k.tiktoken")
ODD = ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "IT'S.", "é.", "“x”", "á", "#.", "x#.", "9,9.", "\x1c", "\x85", "İ.", "Σ", "ΟΔΟΣ.", "日本.", "🙂!", "...", "'S.", "\x00", "ﬁ.", "½.", " ", "  ", "\n", "\t ", "\xa0", "The", "of,"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    return ["", " ", "a" * 3000, *("".join(r.choice(ODD) for _ in range(30)) for _ in range(800))]


def test_word_ids_equal_direct_encoding(texts):
    t, w = Tokenizer.from_file(WORDS), tokens.WordIds(WORDS, 2, most=50)
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        for x, raw in zip(part, w.of([x.encode() for x in part]), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=6))
def test_word_ids_of_any_text(some):
    t, w = tokens._tokenizer(WORDS), tokens.WordIds(WORDS, 2, most=5)
    got = [np.frombuffer(raw, "<u2").tolist() for raw in w.of([x.encode() for x in some])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_counts_equal_direct_encoding(texts):
    c = tokens.TokenCount(RANKS, public.PATTERN, most=50)
    for x in texts:
        assert c.count(x) == len(c.encode(x))


def test_histogram_answers_every_limit(spark, odd_docs, no_docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = [len(enc.encode_ordinary(r.text or "")) for r in odd_docs.collect()]
    h = tokens.length_histogram(odd_docs, RANKS, public.PATTERN, width=7).cache()
    rows = {r.n_tokens: r for r in h.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == Counter(sizes)
    for n, r in rows.items():
        assert (r.docs_ge, r.tokens_ge) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert (r.docs_lt, r.tokens_lt) == (sum(s < n for s in sizes), sum(s for s in sizes if s < n))
        assert r.truncated_total == sum(min(s, n) for s in sizes)
    got = {r.context: (r.kept_tokens, r.cut_docs) for r in tokens.truncated_totals(h, [0, 3, 1000, 10**9]).collect()}
    assert got == {c: (sum(min(s, c) for s in sizes), sum(s > c for s in sizes)) for c in (0, 3, 1000, 10**9)}
    for q in (0.0, 0.5, 0.9, 1.0):
        assert tokens.length_quantile(h, q) == next(s for s in sorted(sizes) if sum(x <= s for x in sizes) >= q * len(sizes))
    empty = tokens.length_histogram(no_docs, RANKS, public.PATTERN)
    assert empty.count() == 0 and tokens.length_quantile(empty, 0.5) is None
    assert tokens.truncated_totals(empty, [5]).first().kept_tokens == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=1500), st.randoms())
def test_elias_fano_round_trip(values, r):
    v = np.sort(np.array(values, np.uint64))
    raw = tokens.EliasFano.encode(v)
    e = tokens.EliasFano(raw)
    assert (e.slice(0, len(v)) == v).all()
    for _ in range(5 if len(v) else 0):
        i = r.randrange(len(v))
        j = r.randint(i, len(v))
        assert (e.slice(i, j) == v[i:j]).all() and e.select(i) == v[i]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 1200, 200_000))
    bits = 8 * len(tokens.EliasFano.encode(ends)) / len(ends)
    assert bits < 2 + np.log2(ends[-1] / len(ends)) + 0.3


def check(rows, docs):
    t, start = Tokenizer.from_file(WORDS), 0
    want = []
    for d, x in sorted(docs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, len(ids), zlib.crc32(ids)))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[0])
    for s, _, n, _ in got:
        assert s == start
        start += n
    assert [g[1] for g in got] == [w[0] for w in want]
    assert Counter(g[1:] for g in got) == Counter(want)


def test_token_files(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(tokens.token_files(odd_docs).collect(), docs)
    assert tokens.token_files(no_docs).count() == 0
    folder = shared_folder(spark, "t")
    listed = tokens.write_token_files(odd_docs, folder, WORDS, end_id=1, files=3)
    check(tokens.read_token_files(listed, block=2).collect(), docs)
    f = tokens.TokenFile(listed.orderBy("part").first().file)
    at = f.offsets(0, len(f))
    assert f.ids(int(at[0]), int(at[1]))[-1] == 1 and (f.offsets(1, 2) == at[1:3]).all()


def test_query_5_digest(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(tokens.op5_token_files(spark, "/root/testdata/sf0.001").collect(), [(r.doc_id, r.text) for r in rows])


def test_a_word_in_another_case_or_before_a_mark_is_not_encoded_again():
    t = tokens._tokenizer(WORDS)
    cores = tokens.Cores(WORDS, 2)
    words = [b"Folio", b"folio", b"folio,", b"FOLIO."]
    want = [np.array(t.encode(w.decode(), add_special_tokens=False).ids, "<u2").tobytes() for w in words]
    assert list(cores.of(words)) == want and set(cores.new) == {b"folio", b",", b".", b""}
    odd = ["J̌", "́.", "é,", "a<|endoftext|>b.", "a<|ENDoftext|>.", "IT'S.", "...a...", "a,,", "1.a.", "日a."]
    want = [np.array(t.encode(w, add_special_tokens=False).ids, "<u2").tobytes() for w in odd]
    assert list(cores.of([w.encode() for w in odd])) == want
    assert tokens._cores(WORDS, 2) is tokens._cores(WORDS, 2)


def test_bytes_of_ids_tell_whose_they_are():
    path = public.path("word_bpe_49k.json")
    words = ["a", "don't", "x,y.z", "</w>", "<|endoftext|>", "<|EndOfText|>", "İ", "Éa", "ÿß", "a\x1cb", "\x1c", " ", "b c", "\u0085", "ﬁ", "é", "123", "\x00", "--", "``tis", "µm", "w" * 300]
    for n in (1, 3, len(words)):
        cores = tokens.Cores(path, 2)
        for at in range(0, len(words), n):
            part = [w.encode() for w in words[at : at + n]]
            want = [np.array(cores.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u2").tobytes() for w in part]
            assert list(cores.of(part)) == want


def test_offsets_are_not_asked_for(monkeypatch):
    cores = tokens.Cores(public.path("word_bpe_49k.json"), 2)
    real, asked = cores.tokenizer, []

    class Counting:
        def encode(self, *a, **k):
            asked.append(a)
            return real.encode(*a, **k)

        encode_batch_fast = staticmethod(real.encode_batch_fast)

    cores.tokenizer = Counting()
    list(cores.of([f"word{i},é{i}".encode() for i in range(50)] + [b"plain", b"Words"]))
    assert not asked


def test_latin_words_pass_by_the_normaliser():
    cores = tokens.Cores(WORDS, 2)
    real, asked = cores.tokenizer, []

    class Counting:
        def encode_batch_fast(self, some, **k):
            asked.extend(some)
            return real.encode_batch_fast(some, **k)

    cores.tokenizer = Counting()
    words = ["Folio,", "IT'S", "ÀÉÎÕÜÞ.", "Straße", "µM", "ÿ", "x×Y÷z", "J̌", "ﬁ", "É<|endoftext|>", "a\x85É", "ÉA\xa0b", "a<B"]
    want = [np.array(real.encode(w, add_special_tokens=False).ids, "<u2").tobytes() for w in words]
    assert list(cores.of([w.encode() for w in words])) == want
    assert sorted(asked) == sorted(["J̌", "ﬁ", "É<|endoftext|>", "a\x85É", "ÉA\xa0b", "a<B"])


def test_words_as_they_stand_are_remembered_over_tasks():
    assert tokens._word_ids(WORDS, 2) is tokens._word_ids(WORDS, 2)
    words = tokens.WordIds(WORDS, 2)
    first, asked = list(words.of([b"Kept, words.", b""])), []
    words.cores = type("Asked", (), {"of": staticmethod(lambda some: asked.extend(some) or [])})
    assert list(words.of([b"Kept, words.", b""])) == first and not asked
