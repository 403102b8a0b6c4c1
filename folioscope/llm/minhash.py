"""Near-duplicate documents: many universal-hash minima, banding, signature and exact verification, connected components.

1. Each document becomes its set of distinct word shingles; documents with equal sets form one class, and classes are the
   nodes of all steps but the last, so thousands of copies cost one row, whatever their doc_ids.
2. The class's signature holds ``bands * rows`` minima of multiply-add universal hashes. Bands of ``rows`` minima are bucket
   keys; buckets of one class are dropped, large ones are dealt out as tiles of two blocks.
3. Inside a tile, signatures are compared: every leader is compared with all members, and a member that no leader took
   leads next, so any two members whose estimate reaches ``threshold - 5 sigma`` end in one tentative cluster.
4. Each member of a tentative cluster is sent once (to a few tiles if the cluster is large) and links are confirmed on the
   full sets in the same leader-by-leader way. No list of pairs is ever made.
5. Connected components of the confirmed links, by alternating large-star and small-star; then of the groups that share a
   doc_id, in the same way.

With 32 bands of 4, a pair at similarity 0.8 shares no bucket with probability 5e-8.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import NULL_ID, WordHash, arrow_rows, clustered, documents, from_key, grams, id_key, let_go, looked_up, mixed, runs, saved, tiled
from .components import components

BANDS, ROWS = 32, 4


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive word hashes; all words as one if there are fewer; empty without words."""
    if 0 < len(words) < k:
        return grams(words, len(words)) ^ np.uint64(len(words))
    return np.unique(grams(words, k))


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    a, b = (r.integers(0, 2**64, n, np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each of the hashes a * x + b mod 2**64 over the set, upper 32 bits."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(s), 512):
        v = np.multiply.outer(a, s[at : at + 512])
        v += b[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sig.reshape(-1, bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), x.shape[:2]).copy()
    for j in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return h.view(np.int64)


def led(n: int, linked) -> np.ndarray:
    """Connected groups of 0..n-1, each named by its first member. linked(i) gives the bool row of i against all.

    Every member of a group is compared with all rows that no group has yet; when there are none left, nothing more is asked for.
    """
    group = np.arange(n)
    open_ = np.ones(n, bool)
    left = n
    for seed in range(n):
        if not left:
            break
        if not open_[seed]:
            continue
        open_[seed] = False
        left -= 1
        todo = [seed]
        while todo and left:
            new = np.flatnonzero(linked(todo.pop()) & open_)
            group[new], open_[new] = seed, False
            left -= len(new)
            todo.extend(new.tolist())
    return group


def _sets(batches, k: int, seed: int, n_hashes: int) -> Iterator[pa.RecordBatch]:
    a, b = hash_family(n_hashes, seed)
    cache = WordHash()
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, t, text in arrow_rows([batch]):
            s = shingle_set(cache.of((text or b"").lower().split()), k)
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            x, y = np.frombuffer(digest, np.int64)
            for column, v in zip(out, (doc, t, len(s), int(x), int(y), signature(s, a, b).tobytes() if len(s) else b""), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), *(pa.int64(),) * 3, pa.binary()), strict=True)], ["doc", "t", "n", "c1", "c2", "sig"])


def _bands(batches, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint32).reshape(b.num_rows, -1)
            keys = band_keys(sig, bands, rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b["doc"].to_numpy(), bands))], ["key", "doc"])


def _star(docs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each document with the smallest one of its group."""
    order = np.lexsort((docs, group))
    g, d = group[order], docs[order]
    first = np.r_[True, g[1:] != g[:-1]]
    hub = d[np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))]
    return d[~first], hub[~first]


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bucket_links(batches, floor: float) -> Iterator[pa.RecordBatch]:
    """Tentative links inside tiles of buckets whose signatures agree often enough."""
    for t in runs(batches, ["key", "tile"], 8_192):
        key, tile, doc = t["key"].to_numpy(), t["tile"].to_numpy(), t["doc"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(t), -1)
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), True])
        two = cut[:-1][np.diff(cut) == 2]
        same = (sig[two] == sig[two + 1]).mean(axis=1) >= floor
        found = [(doc[two + 1][same], doc[two][same])]
        for at, end in zip(cut[:-1], cut[1:], strict=True):
            if end - at > 2:
                s, d = sig[at:end], doc[at:end]
                group = led(end - at, lambda i, s=s: (s == s[i]).mean(axis=1) >= floor)
                found.append(_star(d, group))
        yield _links(found)


def _exact_links(batches, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links inside tiles. A tile's rows share a cluster; side 1 and 2 are its two blocks (0: both are the same)."""
    cache = WordHash()
    for t in runs(batches, ["cluster", "tile"], 2_000):
        cl, tile, doc = (t[c].to_numpy() for c in ("cluster", "tile", "doc"))
        cut = np.flatnonzero(np.r_[True, (cl[1:] != cl[:-1]) | (tile[1:] != tile[:-1]), True])
        found = []
        for at, end in zip(cut[:-1], cut[1:], strict=True):
            sets = [shingle_set(cache.of(x.lower().split()), k) for x in t["text"].slice(at, end - at).to_pylist()]
            size = np.array([len(s) for s in sets])
            nodes, sets, size = doc[at:end][size > 0], [s for s in sets if len(s)], size[size > 0]
            if len(sets) < 2:
                continue
            if len(sets) == 2:
                inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                if 100 * inter >= percent * (size.sum() - inter):
                    found.append((nodes[1:], nodes[:1]))
                continue
            start = np.r_[0, np.cumsum(size)[:-1]]
            vocab, code = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(vocab), np.int32)

            def linked(i, code=code, mark=mark, start=start, size=size):
                mine = code[start[i] : start[i] + size[i]]
                mark[mine] = 1
                inter = np.add.reduceat(mark[code], start)
                mark[mine] = 0
                return 100 * inter >= percent * (size + size[i] - inter)

            found.append(_star(nodes, led(len(sets), linked)))
        yield _links(found)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 7, block: int = 1_500_000, bucket: int = 4_096) -> DataFrame:
    """(doc_key, n_shingles, component, class_id, text_group, text_id) for every row of `docs` (columns doc_id and text; more are ignored).

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of k-word shingles (ASCII letters lower-
    cased). Null and blank texts have empty sets and are linked with nothing; fewer than k words count as one shingle. A null
    doc_id is kept and sorts before all others. Rows with equal doc_id and equal text give equal rows; rows with equal doc_id and
    different texts are in one component, linked through either text. An empty table gives an empty result.
    text_group names what is linked by texts alone (null for an empty set); text_id is text_id() of the row.
    block: shingles, and bucket: signatures, of a tile's block, which bound a task's memory.
    """
    spark = docs.sparkSession
    n_hashes = bands * rows
    floor = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / n_hashes)
    keyed = docs.select(id_key().alias("doc"), text_id().alias("t"), F.col("text").cast("binary").alias("text"))
    sets = saved(keyed.mapInArrow(lambda it: _sets(it, k, seed, n_hashes), "doc long, t string, n long, c1 long, c2 long, sig binary"))
    least = sets.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("doc", "t", "n", "sig")).alias("r")).select("c1", "c2", "r.*")
    reps = saved(least.withColumn("node", F.monotonically_increasing_id()))  # numbers stay as they were saved
    classes = reps.count()
    members = reps.select(F.col("node").alias("doc"), "sig").mapInArrow(lambda it: _bands(it, bands, rows), "key long, doc long")
    low = reps.select(F.col("node").alias("doc"), "sig").mapInArrow(_low_bytes, "doc long, sig binary")
    buckets = tiled(members, "key", "doc", bucket, classes * bands).select("key", "tile", "doc").join(low, "doc")
    near = clustered(buckets, "key", "tile").mapInArrow(lambda it: _bucket_links(it, floor), "a long, b long")
    clusters = components(near)
    let_go(spark)  # the buckets' files
    # one text of each class in a tentative cluster, sent once, or to the tiles of a large cluster
    sized = saved(clusters.join(reps.select("node", "n", "doc", "t"), "node").withColumnRenamed("component", "cluster"))
    placed = tiled(sized, "cluster", "node", block, classes, F.col("n")).select("doc", "t", "cluster", "tile", "node")
    texts = keyed.join(placed, ["doc", "t"]).dropDuplicates(["doc", "t", "tile"]).select("cluster", "tile", F.col("node").alias("doc"), "text")
    exact = clustered(texts, "cluster", "tile").mapInArrow(lambda it: _exact_links(it, k, percent), "a long, b long")
    groups = components(exact).withColumnRenamed("component", "g")
    let_go(spark)  # those of the texts in tiles
    named = reps.select("c1", "c2", "node", F.col("doc").alias("rep")).join(groups, "node", "left").select("c1", "c2", "rep", F.coalesce("g", "node").alias("g"))
    rows_in = sets.count()
    found = saved(sets.drop("sig").join(named, ["c1", "c2"], "left"))  # no class, no group: an empty set
    # groups that share a doc_id are linked; the least doc_id of what is linked names it
    owned = found.where("g is not null").select("doc", "g").distinct()
    shared = owned.groupBy("doc").agg(F.min("g").alias("b"), F.max("g").alias("top"), F.count("*").alias("n_")).where("b < top").select("doc", "b", "n_")
    tops = components(looked_up(owned, shared, "doc", rows_in).select(F.col("g").alias("a"), "b")).select(F.col("node").alias("g"), F.col("component").alias("top"))
    firsts = saved(named.groupBy("g").agg(F.min("rep").alias("rep")).join(tops, "g", "left").select("g", "rep", F.coalesce("top", "g").alias("top")))
    heads = looked_up(firsts.select("g", "top"), firsts.groupBy("top").agg(F.min("rep").alias("component"), F.count("*").alias("n_")), "top", classes).select("g", "component")
    let_go(spark)
    out = found.join(heads, "g", "left")
    return out.select(
        F.col("doc").alias("doc_key"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"), F.coalesce("rep", "doc").alias("class_id"), F.col("g").alias("text_group"), F.col("t").alias("text_id")
    )


def text_id():
    """What names a text; null and empty ones are alike."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _low_bytes(batches) -> Iterator[pa.RecordBatch]:
    """A byte of each minimum: two agree by chance in one of 256 cases, which only adds to an estimate, at a quarter of the size."""
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint32).reshape(b.num_rows, -1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array([r.tobytes() for r in sig], pa.binary())], ["doc", "sig"])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; 4-word shingles and similarity 0.8."""
    d = near_duplicates(documents(spark, sf_dir), k=4)
    return d.select(
        from_key("doc_key").alias("doc_id"),
        "n_shingles",
        from_key("component").alias("component_id"),
        (F.col("doc_key") == F.col("component")).alias("kept"),
    )


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * n >= 80 * (na + nb - n)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM s UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT s.doc_id, len(any_value(s.s)) AS n_shingles, min(reached) AS component_id, s.doc_id = min(reached) AS kept
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id
"""
