"""Quality trees, language network and decontamination."""

import math
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontam, langid, quality

DATA = "/root/testdata/sf0.01"


def test_trees_learn_and_ignore_noise():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    t = quality.fit_trees(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    one = quality.fit_trees(x[:10], np.ones(10))
    assert (one.score(x) > 0.9).all() and one.score(x[:0]).shape == (0,)
    assert quality.fit_trees(x[:0], np.zeros(0)).score(x[:2]) == pytest.approx([0.5, 0.5])


def test_traversal_equals_a_walk_from_the_root():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3)).astype(np.float32)
    t = quality.fit_trees(x, (x[:, 0] > 0).astype(float), rounds=5, depth=3)
    for row, score in zip(x, t.score(x), strict=True):
        total = t.base
        for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + bool(row[f[at]] > c[at])
            total += leaf[at - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_held_out_documents(spark):
    out = {r.doc_id: r for r in quality.op9_quality_classifier(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    held = [(out[r.doc_id].predicted, r.quality) for r in labels if out[r.doc_id].held_out]
    assert len(held) > 40 and np.mean([p == q for p, q in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(11, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    trees = quality.fit_quality(odd_docs, labels)
    assert quality.score_quality(odd_docs, trees).count() == odd_docs.count()
    kept = quality.keep_quality(odd_docs, trees, cut=0.0)
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))
    assert quality.keep_quality(odd_docs, trees, cut=1.1).count() == 0
    assert quality.score_quality(no_docs, quality.fit_quality(no_docs, labels)).count() == 0


def test_windows_cover_every_run_of_bytes():
    r = random.Random(0)
    for n in (0, 1, 4, 251, 252, 255, 256, 257, 260, 508, 509, 2000):
        text = bytes(r.randrange(1, 256) for _ in range(n)).lower()
        w = langid.windows(text)
        have = {bytes(x[i : i + 5]) for x in w for i in range(252)}
        assert all(text[i : i + 5] in have for i in range(n - 4)) and w.shape[1] == 256


def test_gradients_are_right():
    net = langid.ByteNet(["a", "b", "c"], seed=1)
    r = np.random.default_rng(0)
    x, y, w = r.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        return -net.log_probabilities(x)[np.arange(4), y].mean()

    for name, g in net.gradients(x, y, w).items():
        for at in np.argwhere(np.abs(g) > 1e-4)[:3]:
            at, p = tuple(at), net.p[name]
            kept = p[at]
            p[at] = kept + 1e-5
            up = loss()
            p[at] = kept - 1e-5
            down = loss()
            p[at] = kept
            assert (up - down) / 2e-5 == pytest.approx(g[at], rel=0.02, abs=1e-5)


def test_languages_of_held_out_documents(spark):
    out = {r.doc_id: r for r in langid.op4_language_id(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    held = [(out[r.doc_id].lang_pred, r.lang) for r in docs if out[r.doc_id].held_out]
    assert len(out) == len(docs) and np.mean([p == q for p, q in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_languages_of_odd_rows(odd_docs, no_docs):
    net = langid.fit_languages(odd_docs)
    out = langid.predict_languages(odd_docs, net).collect()
    assert len(out) == odd_docs.count()
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {0, 1, 2} <= und and 3 not in und
    assert langid.fit_languages(no_docs) is None
    assert langid.predict_languages(no_docs, net).count() == 0
    assert {r.lang_pred for r in langid.predict_languages(odd_docs, None).collect()} == {"und"}


def leak_case(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(r.randint(14, 60)))) for i in range(30)]
    docs, want = [], {}
    for d in range(200):
        body = [word() for _ in range(r.randint(0, 200))]
        if d % 3 == 0:
            i, text = items[d % 30]
            w = text.split()
            for j in range(r.randrange(5), len(w), r.choice([6, 7, 9, 1000])):
                w[j] = "other"
            part = w[: r.choice([len(w), max(14, len(w) // 2)])]
            body[len(body) // 2 : len(body) // 2] = [x.upper() + r.choice(["", ","]) for x in part]
            want[d] = i
        docs.append((d, " ".join(body)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), want


@pytest.mark.parametrize("most", [decontam.MOST_TOKENS, 100])
def test_leaks_with_substitutions_are_found_and_nothing_else(spark, most):
    docs, items, want = leak_case(spark)
    found = decontam.overlaps(docs, items, most_tokens=most).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(want.items())
    assert all(r.n_equal >= 0.7 * r.n_tokens for r in found)
    assert {r.doc_id for r in decontam.clean(docs, items, most_tokens=most).collect()} == set(range(200)) - set(want)


@pytest.mark.parametrize("n", [*range(3, 30)])
def test_no_allowed_substitutions_escape_the_masks(n):
    """Every way to replace words in one window of an item that leaves enough of them equal."""
    w = min(n, decontam.WINDOW)
    free = w - math.ceil(decontam.SHARE * w)
    item = [f"w{i}" for i in range(n)]
    index = decontam.Index([(1, 0, " ".join(item))], decontam.MASKS, decontam.WINDOW, decontam.SHARE, 3)
    cache = decontam.WordHash()
    at = (n - w) // 2
    for gone in combinations(range(w), free):
        words = [b"x"] * 3 + [b"y" if i in gone else item[at + i].encode() for i in range(w)] + [b"z"]
        found = list(index.overlaps(cache.of(words)))
        assert [(i, d - k) for i, d, k, *_ in found] == [(1, 3 - at)]
    words = [b"y" if i in range(free + 1) else item[at + i].encode() for i in range(w)]
    assert not list(index.overlaps(cache.of(words)))


def every_overlap(text, item, window=decontam.WINDOW, share=decontam.SHARE):
    """All diagonals, all windows."""
    h, t = decontam.tokens(text), decontam.tokens(item)
    w = min(window, len(t))
    best = []
    for d in range(w - len(t), len(h) - w + 1) if w >= decontam.SHORTEST else ():
        a, b = max(0, -d), min(len(t), len(h) - d)
        equal = [t[i] == h[i + d] for i in range(a, b)]
        best += [d for i in range(len(equal) - w + 1) if sum(equal[i : i + w]) >= share * w - 1e-9]
    return set(best)


def test_query_1_against_brute_force(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"w{r.randrange(12)}" for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 12, 13, 14, 30])))) for i in range(30)]
    docs = []
    for d in range(40):
        words = [f"w{r.randrange(12)}" for _ in range(r.randint(0, 60))]
        for _ in range(2):
            part = [w if r.random() < 0.85 else "sub" for w in r.choice(items)[1].split()]
            words[(k := r.randrange(len(words) + 1)) : k] = part
        docs.append((d, " ".join(words)))
    want = {(d, i, k) for d, x in docs for i, t in items for k in every_overlap(x, t)}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.MOST_TOKENS, 20):
        found = decontam.overlaps(df, bench, most_tokens=most).collect()
        assert {(x.doc_id, x.item_id, x.doc_start - x.item_start) for x in found} == want
    assert {x.doc_id for x in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_query_1_digest(spark):
    out = decontam.op1_decontamination(spark, "/root/testdata/sf0.001").collect()
    docs, items = ({x[0]: x.text for x in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()} for t in ("documents", "benchmark"))
    want = set()
    for i, t in items.items():
        words = decontam.tokens(t)
        for d, x in docs.items():
            # two substitutions cut 13 tokens into three parts, one of which has four tokens or more: a shared triple
            if {*zip(words, words[1:], words[2:])} & {*zip(h := decontam.tokens(x), h[1:], h[2:])} and every_overlap(x, t):
                want.add((d, i))
    assert {(x.doc_id, x.item_id) for x in out} == want


def test_one_word_over_and_over():
    index = decontam.Index([(1, 0, "a " * 20_000)], decontam.MASKS, decontam.WINDOW, decontam.SHARE, 3)
    began = time.process_time()
    h = decontam.WordHash().of([b"a"] * 20_000)
    assert len(index.diagonals(h)) >= 2 * 20_000 - 26
    assert next(index.overlaps(h))[0] == 1 and time.process_time() - began < 60


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (None, "another text under a used id"), (5, "another text under a used id")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.overlaps(odd_docs, items).collect()}
    assert found == {(7, -1), (7, 5), (4, 3)}
    assert decontam.overlaps(no_docs, items).count() == 0 and decontam.overlaps(odd_docs, items.where("false")).count() == 0
    kept = decontam.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2


def test_und_is_what_has_no_letter(spark):
    signs = ["½", "²³", "①⑫", "12 3_4", "٣", "Ⅷ", "!?", "", None]
    docs = spark.createDataFrame([(i, f"plain words number {i}", "en") for i in range(30)] + [(100 + i, f"ganz andere Wörter {i}", "de") for i in range(30)], "doc_id long, text string, lang string")
    net = langid.fit_languages(docs)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*signs, "ª", "ß", "语", "½ x"])], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(odd, net).collect()}
    assert all(got[i] == ("und", 0) for i in range(len(signs))) and all(got[i][0] in net.langs for i in range(len(signs), len(got)))


def test_fits_are_bounded_by_rows(spark, monkeypatch):
    """A repeated id does not bring more rows to the driver than the bound; a rare language is learned all the same."""
    ids = spark.range(20_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    docs = ids.withColumn("lang", F.lit("en")).unionByName(spark.createDataFrame([(7, "seltene Wörter", "de")], "doc_id long, text string, lang string"))
    seen = []
    monkeypatch.setattr(langid.ByteNet, "train", lambda self, x, y: seen.append((self.langs, len(x))) or self)
    langid.fit_languages(docs, most=100)
    assert seen[0][0] == ["de", "en"] and seen[0][1] <= 100
    monkeypatch.setattr(quality, "fit_trees", lambda x, y: len(x))
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), *((i, 1) for i in range(50, 400))], "doc_id long, quality int")
    assert quality.fit_quality(docs, labels, most=100) == 100
