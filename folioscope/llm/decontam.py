"""Benchmark decontamination by spaced-seed hashing.

A mask picks some of the next token positions and ignores the others; test and training texts are hashed under every mask at
every position. Equal hashes put an item beside a place in a document, and along that diagonal tokens are compared one by one,
so overlaps with substituted words are found and verified.

Nothing that the definition of an overlap accepts is missed: wherever two of WINDOW tokens are substituted, all positions of one
of MASKS stand in the window untouched. Items shorter than WINDOW are hashed as a whole, under masks chosen by the same rule.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WordHash, arrow_rows, documents, mixed

#: 1: the token counts, 0: it is ignored. Six tokens each.
MASKS = ("11101011", "110100111")
WINDOW, SHARE, WEIGHT = 13, 0.8, 6
#: Items of fewer tokens match nothing: a word or two stand in most texts.
SHORTEST = 3
#: Tokens of benchmark items that are matched in one pass over the documents, which bounds what is sent to each task.
MOST_TOKENS = 1_000_000
_TOKEN = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores."""
    return [w.encode() for w in _TOKEN.findall((text or "").lower())]


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash under a mask at every position at which it fits."""
    n = len(h) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in (j for j, c in enumerate(mask) if c == "1"):
            out = out * _ODD + h[j : j + n]
    return mixed(out)


@functools.cache
def item_masks(length: int, share: float, weight: int = WEIGHT) -> tuple[str, ...]:
    """Masks over a whole short item, such that any substitutions that `share` allows leave all positions of one of them alone."""
    free = length - math.ceil(share * length - 1e-9)
    left = set(combinations(range(length), free))
    some = [(m, {x for x in left if not set(x) & set(m)}) for m in combinations(range(length), min(weight, length - free) if free else length)]
    out = []
    while left:
        best = max(some, key=lambda x: len(x[1] & left))
        out.append("".join("01"[i in best[0]] for i in range(length)))
        left -= best[1]
    return tuple(out)


class Index:
    """Seeds of benchmark items: sorted hashes with item and place, behind a bitmap that most other hashes fail.

    items: (item_id, place of its first token in the whole item, text).
    """

    def __init__(self, items: list[tuple[int, int, str]], masks: tuple[str, ...], window: int, share: float, shortest: int) -> None:
        cache = WordHash()
        self.window, self.share = window, share
        self.ids = np.array([k for k, *_ in items], np.int64)
        self.begin = np.array([b for _, b, _ in items], np.int64)
        self.tokens = [cache.of(tokens(t)) for *_, t in items]
        size = np.array([len(t) for t in self.tokens], np.int64)
        sets = [(m, np.flatnonzero(size >= window)) for m in masks]
        sets += [(m, np.flatnonzero(size == n)) for n in np.unique(size) if shortest <= n < window for m in item_masks(int(n), share)]
        self.by_mask = []
        for mask, which in sets:
            if not len(which):
                continue
            found = [seeds(self.tokens[i], mask) for i in which]
            item = np.repeat(which, [len(s) for s in found])
            place = np.concatenate([np.arange(len(s)) for s in found])
            key = np.concatenate(found)
            order = np.argsort(key, kind="stable")
            bits = max(16, min(26, int(len(key)).bit_length() + 5))
            seen = np.zeros(1 << bits, bool)
            seen[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_mask.append((mask, key[order], item[order], place[order], seen, np.uint64(64 - bits)))

    def diagonals(self, h: np.ndarray) -> np.ndarray:
        """Distinct (item, place in the document less place in the item) of all hits.

        A seed that repeats in both texts has as many hits as the product of its places; it gives its distinct diagonals item by
        item, so memory grows with diagonals, not with hits.
        """
        found = []
        for mask, key, item, place, seen, shift in self.by_mask:
            s = seeds(h, mask)
            at = np.flatnonzero(seen[(s >> shift).astype(np.int64)])
            lo, hi = np.searchsorted(key, s[at], "left"), np.searchsorted(key, s[at], "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            start, which, times = np.unique(lo[hit], return_inverse=True, return_counts=True)
            n = (hi - lo)[hit]
            many = (times * (key.searchsorted(key[start], "right") - start) > 1 << 16)[which]
            few, k = hit[~many], n[~many]
            row = np.repeat(lo[few], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            found.append(np.stack([item[row], np.repeat(at[few], k) - place[row]], axis=1))
            for seed in np.unique(which[many]):
                p = at[hit[which == seed]]
                first, last = int(start[seed]), int(key.searchsorted(key[start[seed]], "right"))
                own = item[first:last]
                for i in np.unique(own):
                    places = place[first:last][own == i]
                    mark = np.zeros(int(p[-1]) + int(places[-1]) + 1, bool)
                    for q in places:
                        mark[p - q + places[-1]] = True
                    d = np.flatnonzero(mark) - places[-1]
                    found.append(np.stack([np.full(len(d), i), d], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def overlaps(self, h: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, start in the document, start in the item, tokens, equal tokens) of each verified stretch of a diagonal."""
        for i, d in self.diagonals(h).tolist():
            item = self.tokens[i]
            a, b = max(0, -d), min(len(item), len(h) - d)
            equal = item[a:b] == h[a + d : b + d]
            w = min(self.window, len(item))
            if len(equal) < w:
                continue
            run = np.r_[0, np.cumsum(equal)]
            good = np.flatnonzero(run[w:] - run[:-w] >= self.share * w - 1e-9)
            if len(good):  # neighbouring windows are one stretch, trimmed to equal tokens at both ends
                for part in np.split(good, np.flatnonzero(np.diff(good) > w) + 1):
                    same = np.flatnonzero(equal[part[0] : part[-1] + w]) + part[0]
                    yield int(self.ids[i]), int(same[0] + a + d), int(same[0] + a + self.begin[i]), int(same[-1] - same[0] + 1), len(same)


OVERLAP = "doc_id long, item_id long, doc_start int, item_start int, n_tokens int, n_equal int"


def _blocks(benchmark: DataFrame, most: int, window: int) -> Iterator[list[tuple[int, int, str]]]:
    """The items in blocks of a bounded number of tokens, read one partition at a time; a longer item is cut into pieces that
    share window - 1 tokens, so that each window lies in one."""
    held, size = [], 0
    step = max(1, most - window + 1)
    for row in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        words = tokens(row.text)
        for begin in range(0, max(1, len(words) - window + 1), step):
            part = words[begin : begin + step + window - 1]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((row.item_id if row.item_id is not None else -1, begin, b" ".join(part).decode()))
            size += len(part)
    if held:
        yield held


_INDEX: dict[str, Index] = {}


def _index(sent, name: str, *options) -> Index:
    """The index of a block, made once per worker process; one is kept."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(sent.value, *options)
    return _INDEX[name]


def overlaps(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE, shortest: int = SHORTEST, most_tokens: int = MOST_TOKENS
) -> DataFrame:
    """One row per verified stretch: doc_id, item_id, doc_start, item_start, n_tokens, n_equal (places in tokens).

    A stretch is made of windows of `window` tokens (a shorter item: all its tokens) of which `share` are equal in place. With
    the given masks, window and share none is missed. Items of fewer than `shortest` tokens, null and empty texts match nothing;
    a null item_id is reported as -1. Repeated documents or items give repeated rows. Nothing is shuffled: each task matches
    whole documents against one block of items at a time, and a larger benchmark means more blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], OVERLAP)
    for block in _blocks(benchmark, most_tokens, window):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index, cache = _index(sent, name, masks, window, share, shortest), WordHash()
            for b in batches:
                found = [(doc, *o) for doc, text in arrow_rows([b]) for o in index.overlaps(cache.of(tokens(text)))]
                columns = list(zip(*found, strict=True)) if found else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

        out = out.unionByName(rows.mapInArrow(run, OVERLAP))
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE, shortest: int = SHORTEST, most_tokens: int = MOST_TOKENS
) -> DataFrame:
    """The rows of `docs` (a column text; all columns stay) without any verified overlap, as defined by :func:`overlaps`."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, most_tokens, window):
        sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index, cache = _index(sent, name, masks, window, share, shortest), WordHash()
            for b in batches:
                ok = [next(index.overlaps(cache.of(tokens(text))), None) is None for (text,) in arrow_rows([b.select([at])])]
                yield b.filter(pa.array(ok, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap between a document and a benchmark item: the longest stretch of each pair, and how many there are."""
    found = overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.max(F.struct("n_equal", "n_tokens", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i")))
    g = found.groupBy("doc_id", "item_id").agg(best.alias("b"), F.count("*").alias("n_stretches"))
    return g.select(
        "doc_id", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), "b.n_tokens", "b.n_equal", "n_stretches",
        (F.col("b.n_equal") / F.col("b.n_tokens")).alias("similarity"),
    )
