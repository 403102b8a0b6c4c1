"""Which page contains a term: rolling hashes of the pages behind bitmaps of the needles, then an equality join on the strings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_blanks
from .shared import saved

#: Lengths at which every place of a page is hashed; a needle is looked for by the longest that fits into it.
ANCHORS = (12, 8, 4, 2, 1)
#: Bits of a bitmap at least and at most (64 MB); up to some 30 million needles it stays sparse, with more it only spares less.
_BITS = (1 << 20, 1 << 29)
_SEGMENT = 1 << 19
_PIECE = 1 << 20  # characters hashed at once
_HELD = 200_000  # findings of a task before it reports them
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    up = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


class _Hashed:
    """Texts laid end to end; the hash of any stretch is the difference of two sums."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "".join(texts)
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.size = len(codes)
        self.ends = np.cumsum([len(t) for t in texts])
        up, self.down = _powers(1 << max(_PIECE.bit_length(), (self.size + 1).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: self.size], dtype=np.uint64)])

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self._mixed((self.sums[at + length] - self.sums[at]) * self.down[at], length)

    def everywhere(self, length: int) -> np.ndarray:
        """The hashes of this length at all places, in order."""
        n = max(self.size - length + 1, 0)
        return self._mixed((self.sums[length : length + n] - self.sums[:n]) * self.down[:n], length)

    @staticmethod
    def _mixed(x: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        x += np.atleast_1d(np.asarray(length, np.uint64)) * np.uint64(_BASE)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@dataclass
class _Sieve:
    """Bitmaps of the needles' anchors and of whole needles, and the needles' lengths by anchor."""

    anchors: np.ndarray
    wholes: np.ndarray
    lengths: dict[int, list[int]]

    def __post_init__(self) -> None:
        self.longest = max((x for v in self.lengths.values() for x in v), default=0)

    @staticmethod
    def passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        bit = (h & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
        return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def found(self, t: _Hashed) -> Iterator[tuple[int, int]]:
        """(place, length) of all stretches of one text that may be needles."""
        for anchor, lengths in self.lengths.items():
            at = np.flatnonzero(self.passes(self.anchors, t.everywhere(anchor)))
            room = t.ends[np.searchsorted(t.ends, at, "right")] - at
            for n in lengths:
                here = at[room >= n]
                yield from ((int(i), n) for i in here[self.passes(self.wholes, t.hashes(here, n))])


def _portions(rows: Iterator[tuple[int, str]], size: int, overlap: int = 0) -> Iterator[tuple[list[int], list[str]]]:
    """Rows with some `size` characters at a time; longer texts in pieces that overlap."""
    ids, texts, n = [], [], 0
    for i, text in rows:
        for begin in range(0, max(len(text) - overlap, 1), size):
            piece = text[begin : begin + size + overlap]
            if texts and n + len(piece) > size:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(i)
            texts.append(piece)
            n += len(piece)
    if texts:
        yield ids, texts


def _anchor(length: int, anchors: tuple[int, ...]) -> int:
    return next(a for a in anchors if a <= length)


def _sieve(needles: DataFrame) -> _Sieve:
    """The bitmaps of the needles, built in segments on the executors; their bounded bytes and the set of lengths reach the driver."""
    lengths: dict[int, list[int]] = {}
    about = needles.groupBy(F.length("needle").alias("length")).agg(F.count("*").alias("n")).collect()
    for n in sorted(r.length for r in about):
        lengths.setdefault(_anchor(n, ANCHORS), []).append(n)
    longest = max((r.length for r in about), default=0)
    bits = min(max(_BITS[0], 1 << (16 * sum(r.n for r in about)).bit_length()), _BITS[1])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in _portions(((0, x) for x in b["needle"].to_pylist()), max(_PIECE, longest)):
                t = _Hashed(texts)
                size = np.array([len(x) for x in texts])
                at = t.ends - size
                for which, h in enumerate((t.hashes(at, np.array([_anchor(n, ANCHORS) for n in size])), t.hashes(at, size))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), which, np.int32)), pa.array((h & np.uint64(bits - 1)).astype(np.int64))], ["which", "bit"])

    def folded(group: pa.Table) -> pa.Table:
        bit = group["bit"].to_numpy()
        held = np.zeros(_SEGMENT, np.uint8)
        held[bit % _SEGMENT] = 1
        first = [pa.array([group["which"][0].as_py()], pa.int32()), pa.array([int(bit[0]) // _SEGMENT], pa.int64())]
        return pa.Table.from_arrays([*first, pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["which", "segment", "bytes"])

    places = needles.select("needle").mapInArrow(hashed, "which int, bit long").distinct()
    parts = places.groupBy("which", F.floor(F.col("bit") / _SEGMENT)).applyInArrow(folded, "which int, segment long, bytes binary")
    maps = np.zeros((2, bits // 8), np.uint8)
    for which, segment, held in parts.collect():
        maps[which, segment * _SEGMENT // 8 : (segment + 1) * _SEGMENT // 8] = np.frombuffer(held, np.uint8)
    return _Sieve(maps[0], maps[1], lengths)


def page_of(terms: DataFrame, pages: DataFrame, lengths: tuple[int, ...] = (40, 24, 12), shortest: int = 8, piece: int = _PIECE) -> DataFrame:
    """(tid, page_no): the first page that contains the first needle that any page contains; null without one.

    terms: tid, term, text; pages: page_no, text of one document. Needles are, without white space: the term followed by the
    first characters of its text (first two lengths), then the first characters of the text. Those shorter than `shortest` are
    skipped. Each page is read once, in place: places whose hash is among the needles' anchors, then whole needles', are reported as
    strings with the least page of a task, so a needle is a row a task at most, plus the few that the bitmaps let through. Strings
    join strings, so the result is exact; terms that share a needle are rows of that join, which Spark splits where it is skewed.
    """
    t = terms.select("tid", without_blanks(F.col("term")).alias("term"), without_blanks(F.col("text")).alias("text"))
    own = [F.when(F.col("term") != "", F.substring(F.concat("term", "text"), F.lit(1), F.length("term") + n)) for n in lengths[:2]]
    each = F.array(*own, *(F.substring("text", 1, n) for n in lengths))
    needles = saved(t.select("tid", F.posexplode(each).alias("pos", "needle")).where(F.length("needle") >= max(shortest, 1)))
    sent = terms.sparkSession.sparkContext.broadcast(_sieve(needles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, best = sent.value, {}
        report = lambda: pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array(list(best.values()), pa.int64())], ["needle", "page_no"])
        for b in batches:
            rows = zip(b["page_no"].to_pylist(), b["body"].to_pylist(), strict=True)
            for numbers, texts in _portions(rows, max(piece, sieve.longest), max(sieve.longest - 1, 0)):
                h = _Hashed(texts)
                for at, n in sieve.found(h):
                    needle, page = h.text[at : at + n], numbers[int(np.searchsorted(h.ends, at, "right"))]
                    if page < best.get(needle, page + 1):
                        best[needle] = page
                if len(best) > _HELD:
                    yield report()
                    best = {}
        yield report()

    bodies = pages.select(F.col("page_no").cast("long"), without_blanks(F.col("text")).alias("body")).where("page_no is not null and body is not null")
    found = bodies.mapInArrow(run, "needle string, page_no long").groupBy("needle").agg(F.min("page_no").alias("page_no"))
    best = needles.join(found, "needle").groupBy("tid").agg(F.min(F.struct("pos", "page_no")).alias("b")).select("tid", "b.page_no")
    return terms.select("tid").join(best, "tid", "left")
