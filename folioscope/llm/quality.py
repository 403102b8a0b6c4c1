"""A quality classifier: histogram gradient-boosted trees over document statistics, flattened for vectorised traversal."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents

#: Rows that the trees are fitted on at most; which ones is decided by a hash of the id.
MOST_FIT = 20_000
CUT = 0.3

_CLASS = np.full(256, 6, np.uint8)  # 0 lower case, 1 upper case, 2 digit, 3 blank, 4 sentence marks, 5 other ASCII, 6 beyond ASCII
_CLASS[:128] = 5
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?!'\"-()")):
    _CLASS[list(_chars)] = _k
STATISTICS = 7 + 14


def statistics(text: bytes | None) -> list[float]:
    """Statistics of the whole text; all zero for a null or empty one."""
    if not text:
        return [0.0] * STATISTICS
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    by = np.bincount(raw, minlength=256)
    shares = np.bincount(_CLASS, by, 7) / n
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    triples = max(1, len(words) - 2)
    length = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    odd = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128)
    return [
        *shares, float(np.log1p(n)), float(np.log1p(len(words))), float(length.mean()), float(length.std()), len(seen) / m,
        (max(seen.values()) if seen else 0) / m, len(set(zip(words, words[1:], words[2:], strict=False))) / triples, len(set(lines)) / k,
        float(np.log1p(n / k)), odd / m, sum(c for w, c in seen.items() if w.isupper()) / m, float(by[33] / n), float((by > 0).sum()), float((by[33:48].sum() - by[44] - by[46]) / m),
    ]


def _features(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            yield part, np.array([statistics(t.encode() if isinstance(t, str) else t) for t in part["text"].to_pylist()], np.float32).reshape(-1, STATISTICS)


class Trees:
    """Complete trees of one depth: arrays of split features, thresholds and leaf values, all trees traversed at once."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; NaN goes left."""
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if trees:
            t, rows = np.arange(trees), np.arange(len(x))[:, None]
            at = np.zeros((len(x), trees), np.int64)
            while at[0, 0] < inner if len(x) else False:
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees for log loss. One class or no rows give a constant score."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    inner = 2**depth - 1
    empty = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # code <= b as x <= cuts[b]
    total = np.full(len(y), base)
    feature, cut, leaf = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-total))
        g, h = q - y, q * (1 - q)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, pick = np.zeros(width), np.full((width, 2), -1)
            for j in range(x.shape[1]):
                slot = (at - first) * bins + code[:, j]
                gs, hs = (np.bincount(slot, v, width * bins).reshape(width, bins) for v in (g, h))
                gl, hl = np.cumsum(gs, axis=1)[:, :-1], np.cumsum(hs, axis=1)[:, :-1]
                gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-9
                best[better] = gain[np.arange(width), top][better]
                pick[better] = np.stack([np.full(width, j), top], axis=1)[better]
            for k in range(width):
                if pick[k, 0] >= 0:
                    f[first + k], c[first + k] = pick[k, 0], cuts[pick[k, 0]][pick[k, 1]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        at -= inner
        value = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        total += value[at]
        feature.append(f), cut.append(c), leaf.append(value)
    return Trees(base, np.array(feature), np.array(cut), np.array(leaf))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, seed: int = 9) -> Trees:
    """Trees from at most `most` labelled documents, those with the least seeded hash of their id.

    labels: doc_id, quality (0 or 1; nulls are ignored, as are null ids and documents without a row in `docs`).
    """
    fit = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("y"))
    order = (F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "y")
    fit = fit.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(most)  # a proven bound: `most` rows
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(fit), "doc_id")

    def run(batches):
        for part, x in _features(batches):
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["y"], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    # an id that repeats on either side brings more rows than it had labels, so the bound is set once more
    got = rows.mapInArrow(run, "doc_id long, y int, x binary").orderBy(*order, "x").limit(most).toPandas().sort_values(["doc_id", "y", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, STATISTICS)
    return fit_trees(x, got["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) for every row of `docs`, from the whole text; null and empty texts get a score too."""

    def run(batches):
        for part, x in _features(batches):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(trees.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, trees: Trees, cut: float = CUT) -> DataFrame:
    """The rows of `docs` whose score is at least `cut`, all columns unchanged."""

    def run(batches):
        for b in batches:
            for part, x in _features([b]):
                yield part.filter(pa.array(trees.score(x) >= cut))

    return docs.mapInArrow(run, docs.schema)


def held_out(modulus: int, remainder: int, col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learned from labelled rows that are not held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = fit_quality(docs, labels.where(~held_out(5, 0)))
    scored = score_quality(docs, trees)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
