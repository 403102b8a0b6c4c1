"""Terms and the first pages that contain them, against a search of all strings."""

import random
import re

import numpy as np
import pytest

from folioscope.operators import containment as C

TERMS, PAGES = "tid long, term string, text string", "page_no long, text string"


def wanted(terms, pages, lengths=(40, 24, 12), shortest=8):
    squeeze = lambda x: re.sub(r"\s+", "", x or "")
    bodies = sorted((p, squeeze(b)) for p, b in pages if p is not None)
    out = {}
    for tid, term, text in terms:
        term, text = squeeze(term), squeeze(text)
        needles = [(term + text)[: len(term) + n] for n in lengths[:2] if term] + [text[:n] for n in lengths]
        out[tid] = next((p for x in needles if len(x) >= shortest for p, b in bodies if x in b), None)
    return out


def got(spark, terms, pages, parts=3, **options):
    t, p = spark.createDataFrame(terms, TERMS), spark.createDataFrame(pages, PAGES).repartition(parts)
    return {r.tid: r.page_no for r in C.page_of(t, p, **options).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_search_of_all_strings(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ab 가\U0001f600") for _ in range(n))  # noqa: E731  few letters: many chance hits
    pages = [(i, word(r.choice([0, 5, 60, 400]))) for i in range(40)] + [(None, "nobody's"), (99, None), (3, word(50))]
    cut = lambda: (lambda b: b[(i := r.randrange(len(b) + 1)) : i + r.choice([3, 10, 15, 30, 60])])(r.choice(pages)[1] or "")
    terms = [(i, r.choice(["", None, word(3), cut()]), r.choice([cut(), cut() + word(20), "", word(50)])) for i in range(150)]
    lengths = r.choice([(40, 24, 12), (9, 5, 3)])
    for shortest, piece in ((8, 1 << 20), (2, 64), (1, 7)):
        assert got(spark, terms, pages, r.choice([1, 5]), lengths=lengths, shortest=shortest, piece=piece) == wanted(terms, pages, lengths, shortest)


def test_very_long_terms_and_pages_and_shared_needles(spark):
    r = random.Random(5)
    body = "".join(r.choice("abcdefgh") for _ in range(60_000))
    pages = [(2, body), (1, body[:30_000]), (3, "x" * 20_000)]
    long = body[9_990:40_000]
    terms = [(i, "", body[20_000:20_040]) for i in range(3000)] + [(3001, long, "and more"), (3002, long, body[40_000:40_050]), (3003, "x" * 15_000, "x" * 100)]
    assert got(spark, terms, pages, piece=1000) == {**dict.fromkeys(range(3000), 1), 3001: None, 3002: 2, 3003: 3}


def test_no_terms_and_no_pages(spark):
    assert got(spark, [], [(1, "abcdefghij")]) == {} and got(spark, [(1, "abcdefghij", "")], []) == {1: None}
    assert got(spark, [(1, "", ""), (2, None, None)], [(1, "abcdefghij")]) == {1: None, 2: None}


def test_hashes_are_those_of_the_stretch_wherever_it_lies():
    r = random.Random(1)
    text = ["".join(r.choice("ab") for _ in range(n)) for n in (5, 0, 300, 40)]
    h, whole = C._Hashed(text), "".join(text)
    for n in (1, 2, 8, 40):
        at = np.arange(len(whole) - n + 1)
        by = {}
        for i, x in zip(at, h.hashes(at, n), strict=True):
            by.setdefault(whole[i : i + n], set()).add(int(x))
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
        assert {whole[:n]: {int(C._Hashed([whole[:n]]).hashes(np.array([0]), n)[0])}}.items() <= by.items()


def test_pieces_cover_every_stretch():
    r = random.Random(2)
    for _ in range(200):
        size, overlap = r.randrange(4, 20), r.randrange(0, 4)
        rows = [(i, "".join(r.choice("abc") for _ in range(r.randrange(0, 60)))) for i in range(4)]
        have = {(i, t[a : a + overlap + 1]) for ids, texts in C._portions(iter(rows), size, overlap) for i, t in zip(ids, texts, strict=True) for a in range(len(t) - overlap)}
        assert have == {(i, t[a : a + overlap + 1]) for i, t in rows for a in range(len(t) - overlap)}
        assert all(sum(map(len, texts)) <= size + overlap for _, texts in C._portions(iter(rows), size, overlap))
