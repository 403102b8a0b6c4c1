"""Near duplicates, components, repeated passages and near embeddings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from folioscope.llm import embed, minhash, substring
from folioscope.llm.base import grams
from folioscope.llm.components import components


def union(n, links):
    p = list(range(n))

    def top(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        p[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components_of_a_path_a_star_and_a_ring(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(5, 5), (7, 7)]
    edges = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{200 + i: 200 for i in range(30)}, **{300 + i: 300 for i in range(9)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    w = tuple((text or "").encode().lower().split())
    return {w[i : i + k] for i in range(len(w) - k + 1)} if len(w) >= k else ({w} if w else set())


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = union(len(rows), links)
    least = {}
    for i, t in enumerate(top):
        least[t] = min(least.get(t, rows[i][0]), rows[i][0])
    return {rows[i][0]: (len(sets[i]), least[top[i]]) for i in range(len(rows))}


@pytest.mark.parametrize("options", [{}, {"block": 150}, {"bucket": 1}, {"bucket": 3, "block": 1}])
def test_near_duplicates(copies, options):
    rows = sorted((r.doc_id, r.text) for r in copies.collect())
    want = brute(rows, 4)
    got = {r.doc_key: (r.n_shingles, r.component) for r in minhash.near_duplicates(copies, k=4, **options).collect()}
    assert got == want and len(set(c for _, c in got.values())) < len(got)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    out = minhash.near_duplicates(odd_docs)
    assert out.count() == odd_docs.count()
    got = {(r.doc_key, r.n_shingles): r.component for r in out.collect()}
    assert got[(0, 0)] == 0 and got[(12, 11996)] == 11  # a null text stays alone; two long copies are one
    assert minhash.near_duplicates(no_docs).count() == 0


def test_grams_tell_order_and_length():
    h = np.array([3, 5, 3, 5, 3], np.uint64)
    for k in range(1, 6):
        g = grams(h, k)
        assert len(g) == 6 - k and all((g[i] == g[j]) == ((h[i : i + k] == h[j : j + k]).all()) for i in range(len(g)) for j in range(len(g)))
    assert len(grams(h, 6)) == 0


def plain_removal(rows, window):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = (t or "").encode().split()
        starts = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        gone = {j for i, s in enumerate(starts) if s in seen and seen[s] != d for j in range(i, i + window)}
        out.setdefault(d, []).append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
        for s in starts:
            seen.setdefault(s, d)
    return {d: sorted(v) for d, v in out.items()}


@pytest.mark.parametrize("window, lengths, most", [(50, (12, 24), 10**6), (50, (12, 24), 1), (20, (6,), 10**6), (20, (6, 8, 13), 3), (20, (6, 8, 13), 1), (8, (8,), 10**6), (8, (8,), 1)])
def test_repeated_passages(copies, window, lengths, most):
    want = plain_removal([(r.doc_id, r.text) for r in copies.collect()], window)
    got = {}
    for r in substring.remove_repeats(copies, window, lengths, most).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_text))
    assert got == want and sum(v[0][1] for v in got.values()) > 500


def test_repeated_passages_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = {}
    for r in substring.remove_repeats(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_text))
    assert {d: sorted(v) for d, v in got.items()} == plain_removal(rows, 50)
    assert got[12] == [(12000, 12000, "")]
    assert substring.remove_repeats(no_docs).count() == 0


def test_groups_join_through_members_that_lead_nothing():
    links = [(0, 2), (1, 3), (2, 3), (5, 4)]
    near = np.zeros((6, 6), bool)
    for a, b in links:
        near[a, b] = near[b, a] = True
    assert minhash.led(6, lambda i: near[i]).tolist() == [0, 0, 0, 0, 4, 4]
    assert minhash.led(0, None).tolist() == []


def vectors():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 32))
    for g in range(30):  # tight and loose groups, chains at the threshold
        c, s = r.normal(size=32), r.choice([0.02, 0.15, 0.3])
        x = np.concatenate([x, c + s * r.normal(size=(r.integers(2, 12), 32))])
    x = np.concatenate([x, x[:5], 7 * x[5:9]])
    return x[r.permutation(len(x))]


@pytest.mark.parametrize("block", [embed.BLOCK, 3])
def test_near_embeddings(spark, block):
    x = vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    top = union(len(x), np.argwhere(near).tolist())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed.near_embeddings(df, block=block).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.999 * near.sum()
    assert sum(got[i].component_id != top[i] for i in range(len(x))) <= 1
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_odd_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, key string, n int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed.near_embeddings(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 3, 4, 5, 6, 7, 8, 9)]  # 1: a used id with another vector
    assert got == sorted([(1, 2, None, False), (1, 2, None, False), (2, 2, None, False), (None, 2, None, True), *alone], key=str)
    assert embed.near_embeddings(df.where("false")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    x = r.normal(size=64)
    x /= np.linalg.norm(x)
    off = r.normal(size=(4000, 64))
    off -= (off @ x)[:, None] * x
    y = 0.6 * x + 0.8 * off / np.linalg.norm(off, axis=1, keepdims=True)
    coder = embed.Coder(64, 8, 1, 5)
    code, f = coder.code(np.vstack([x, y]))
    est = embed.estimates((x @ coder.first.T)[None, :], code, f)[0, 1:]
    assert abs(est.mean() - 0.6) < 0.01
    assert (np.abs(est - 0.6) <= embed.bounds(f, 64, 0.6)[1:]).mean() > 0.999


def test_codes_of_near_vectors_differ_in_few_places():
    r = np.random.default_rng(8)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = r.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    coder = embed.Coder(64, 8, 1, 5)
    differ = np.bitwise_count(coder.code(x)[0] ^ coder.code(y)[0]).sum(1)
    assert (differ > embed.most_differences(embed.code_size(64), 0.95, 1e-3)).mean() <= 2e-3
    few = coder.code(np.vstack([x[:50], y[:3]]))[0]
    want = [any((np.bitwise_count(few[i] ^ few[j]).sum() <= 16) for j in range(53) if j != i) for i in range(53)]
    assert embed.near_codes(few, 16).tolist() == want


def test_equal_vectors_are_one_class(spark):
    r = np.random.default_rng(9)
    base, near = np.ones(16), np.ones(16) + 0.05 * r.normal(size=16)
    rows = [(i, base.tolist()) for i in range(5000)] + [(5000 + i, near.tolist()) for i in range(3)] + [(5003, (-base).tolist())]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embed.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (5002, 0) for i in range(5003)} | {5003: (0, 5003)}


def test_query_7_digest(spark):
    out = minhash.op7_minhash_near_dedup(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = brute(sorted((r.doc_id, r.text) for r in rows), 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == want


def test_query_10_digest(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {d: (v[0][0], v[0][1], hashlib.sha256(v[0][2].encode()).hexdigest()) for d, v in plain_removal(rows, 50).items()}
    got = substring.op10_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
