"""Repeated passages: prefix-partitioned suffix trees over sampled suffixes.

A passage of `window` words that stands in two documents holds the same runs of words of the first of LENGTHS in both, and of them
the one with the least hash at the same place. Only suffixes that begin at such a run are kept (about one in twenty), and of them
only those whose run stands in two documents. That run is the prefix by which suffixes are dealt out, so all suffixes under one
prefix meet in one group. A prefix with more suffixes than fit is made longer, to the next of LENGTHS, until its groups fit: to
the right as far as a window reaches, and to the left from there. At full length the window is its own prefix; what is left
of its tree is one leaf, whose least document is an aggregate that needs no group in one place.

Of each group the tree is built as sorted suffixes with the longest common prefixes of neighbours: the suffixes under one node
of depth d are a run in which no neighbour shares less than d words. The words before the prefix are a second tree, over reversed
left contexts. A window that begins o words before the prefix is shared exactly by the suffixes under one right node of depth
window - o and one left node of depth o; the least document under both decides whether the window is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WordHash, arrow_rows, clustered, documents, from_key, grams, id_key, looked_up, runs, saved

#: Words of a prefix; the window is the last length.
LENGTHS = (12, 24)
#: Documents under one prefix, above which it is made longer.
MOST = 4_096


def anchors(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, places, and the first and last window start of the windows whose least prefix stands there."""
    g = grams(h, prefix)
    reach = window - prefix + 1
    if len(h) < window:
        z = np.empty(0, np.int64)
        return np.empty(0, np.int64), z, z, z
    views = np.lib.stride_tricks.sliding_window_view(g, reach)
    place = np.concatenate([views[i : i + 4096].argmin(axis=1) + np.arange(i, min(i + 4096, len(views))) for i in range(0, len(views), 4096)])
    # the least of windows further right never stands further left, so each place owns one run of windows
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return g[place[first]].view(np.int64), place[first], first, last


def longer(h: np.ndarray, found: tuple[np.ndarray, ...], window: int, prefix: int, length: int) -> tuple[np.ndarray, ...]:
    """The runs of `found` (as from anchors) under prefixes of `length` words in place of `prefix` words.

    Windows with room for the words behind stay together; in each other one the prefix is made of the window's last words.
    """
    _, place, first, last = found
    room = np.maximum(first, place + length - window)  # the first window that has room behind the place
    whole = room <= last
    alone = [np.arange(f, min(r, t + 1)) for f, r, t in zip(first, room, last, strict=True)]
    single = np.concatenate([*alone, np.empty(0, np.int64)]).astype(np.int64)
    place = np.concatenate([place[whole], single + window - length])
    return grams(h, length)[place].view(np.int64), place, np.concatenate([room[whole], single]), np.concatenate([last[whole], single])


def _levels(h: np.ndarray, window: int, lengths: tuple[int, ...], hot: list[list[int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows under the prefixes of each length; those of the next length come from prefixes in `hot`."""
    found = anchors(h, window, lengths[0])
    yield found
    for prefix, length, keys in zip(lengths, lengths[1:], hot, strict=False):
        here = np.isin(found[0], np.array(keys, np.int64))
        found = longer(h, tuple(x[here] for x in found), window, prefix, length)
        yield found


def _by_level(wanted: list[dict], n: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for x in wanted:
        out[x["level"]].append(x["prefix"])
    return out


def _prefixes(batches, window: int, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The distinct prefixes of the last length, of documents with the hot ones of the lengths before."""
    cache = WordHash()
    for b in batches:
        out = [[], [], []]
        for doc, h, text, *hot in arrow_rows([b]):
            *_, found = _levels(cache.of((text or b"").split()), window, lengths, _by_level(hot[0], len(lengths)) if hot else [])
            a = np.unique(found[0])
            out[0].append(a), out[1].append(np.full(len(a), doc)), out[2].append(np.full(len(a), h))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.empty(0, np.int64)]).astype(np.int64)) for c in out], ["prefix", "doc", "h"])


_SUFFIX = pa.schema([("level", pa.int32()), ("prefix", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("at", pa.list_(pa.int32())), ("left", pa.int32()), ("words", pa.binary())])


def _suffixes(batches, window: int, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Suffixes at prefixes that stand in two documents, with the words of their windows; equal ones of a document are one row."""
    cache = WordHash()
    for doc, h, text, hot, fit, _ in arrow_rows(batches):
        words = text.split()
        hot, fit = _by_level(hot, len(lengths)), _by_level(fit, len(lengths))
        rows: dict[tuple, list[int]] = {}
        for level, (a, place, first, last) in enumerate(_levels(cache.of(words), window, lengths, hot)):
            for k in np.flatnonzero(np.isin(a, np.array(fit[level], np.int64))):
                key = (level, int(a[k]), int(place[k] - first[k]), b" ".join(words[first[k] : last[k] + window]))
                rows.setdefault(key, []).append(int(place[k]))
        if rows:
            keys = list(rows)
            columns = ([k[0] for k in keys], [k[1] for k in keys], [doc] * len(keys), [h] * len(keys), list(rows.values()), [k[2] for k in keys], [k[3] for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SUFFIX.types, strict=True)], schema=_SUFFIX)


def _leaves(batches, window: int, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Where windows stand that are prefixes of full length and repeats."""
    cache = WordHash()
    for doc, h, text, hot, _, gone in arrow_rows(batches):
        if gone:
            *_, (a, _, first, _) = _levels(cache.of(text.split()), window, (*lengths, window), _by_level(hot, len(lengths)))
            at = first[np.isin(a, np.array(gone, np.int64))]
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.full(n, h)), pa.array(at), pa.array(at + window)], ["doc", "h", "start", "end"])


def _common(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by group and keys, and how many keys each shares with the one before it (-1: other group)."""
    order = np.lexsort((*keys.T[::-1], group))
    k, g = keys[order], group[order]
    differs = np.hstack([k[1:] != k[:-1], np.ones((len(k) - 1, 1), bool)])  # the last column ends rows that are equal throughout
    lcp = differs.argmax(axis=1)
    lcp[g[1:] != g[:-1]] = -1
    return order, np.r_[-1, lcp]


def _nodes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """The number of each row's node at a depth of its tree."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(lcp < depth)
    return node


def repeats_in(prefix_: np.ndarray, doc: np.ndarray, left: np.ndarray, contexts: list[np.ndarray], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated windows reach before and behind the prefix of each row; (-1, -1) if none is repeated."""
    m = len(doc)
    size = np.array([len(c) for c in contexts])
    off = np.r_[0, np.cumsum(size)[:-1]]
    flat = np.concatenate(contexts)
    alone = np.arange(m, dtype=np.uint64) + np.uint64(2**63)  # stands behind a context's end; equals no other row's

    def grid(width: int, place) -> np.ndarray:
        j = place(np.arange(width))
        ok = (j >= 0) & (j < size[:, None])
        return np.where(ok, flat[np.clip(off[:, None] + j, 0, len(flat) - 1)], alone[:, None])

    right = grid(window - prefix, lambda j: left[:, None] + prefix + j)  # the prefix itself is equal in a group
    before = grid(window - prefix, lambda j: left[:, None] - 1 - j)
    r_order, r_lcp = _common(right, prefix_)
    l_order, l_lcp = _common(before, prefix_)
    least, most = np.full(m, window), np.full(m, -1)
    for o in range(window - prefix + 1):
        rows = np.flatnonzero((o <= left) & (left + window - o <= size))
        if not len(rows):
            continue
        key = _nodes(r_order, r_lcp, window - o - prefix)[rows] * m + _nodes(l_order, l_lcp, o)[rows]
        order = np.lexsort((doc[rows], key))
        k, d = key[order], doc[rows][order]
        begin = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], np.arange(len(k)), 0))
        hit = rows[order[d > d[begin]]]
        least[hit], most[hit] = np.minimum(least[hit], o), np.maximum(most[hit], o)
    return most, np.where(most >= 0, window - least, -1)


def _repeats(batches, window: int, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for whole in runs(batches, ["level", "prefix"], 8_192):
        levels = whole["level"].to_numpy()
        for level in np.unique(levels):
            t = whole.filter(pa.array(levels == level))
            contexts = [cache.of(x.split()) for x in t["words"].to_pylist()]
            before, behind = repeats_in(t["prefix"].to_numpy(), t["doc"].to_numpy(), t["left"].to_numpy().astype(np.int64), contexts, window, lengths[level])
            hit = np.flatnonzero(before >= 0)
            if len(hit):
                at = t["at"].combine_chunks().take(pa.array(hit))
                who, where = np.repeat(hit, np.diff(at.offsets.to_numpy())), at.flatten().to_numpy().astype(np.int64)
                columns = (t["doc"].to_numpy()[who], t["h"].to_numpy()[who], where - before[who], where + behind[who])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "h", "start", "end"])


def repeated_spans(keyed: DataFrame, window: int = 50, lengths: tuple[int, ...] = LENGTHS, most: int = MOST) -> DataFrame:
    """(doc, h, start, end): spans of words covered by windows that also start in a smaller document.

    keyed: doc (long, never null), h (a hash of the text) and text (binary). lengths: words of prefixes, ascending, `window` at
    most; most: documents under one prefix, above which it is made longer.
    """
    steps = (*lengths, window)
    entry = F.struct(F.col("level"), F.col("prefix"))
    docs, wanted = keyed, None
    for level in range(len(steps)):
        found = saved(docs.mapInArrow(lambda it, n=level + 1: _prefixes(it, window, steps[:n]), "prefix long, doc long, h long"))
        stats = found.groupBy("prefix").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n_")).where("lo < hi")
        leaf = level == len(lengths)
        stats = stats.select("prefix", "n_", "lo", (F.lit(not leaf) & (F.col("n_") > most)).alias("hot"))
        shared = looked_up(found, stats, "prefix", found.count()).withColumn("level", F.lit(level))
        if leaf:
            shared = shared.where("doc > lo")
        shared = saved(shared.select("doc", "h", "level", "prefix", "hot"))
        wanted = shared if wanted is None else wanted.unionByName(shared)
        if leaf or not shared.where("hot").limit(1).count():
            break
        hot = wanted.where("hot").groupBy("doc", "h").agg(F.collect_list(entry).alias("hot"))
        docs = keyed.join(hot, ["doc", "h"]).select("doc", "h", "text", "hot")
    full = F.col("level") == len(lengths)
    lists = wanted.groupBy("doc", "h").agg(
        F.collect_list(F.when(F.col("hot"), entry)).alias("hot"), F.collect_list(F.when(~F.col("hot") & ~full, entry)).alias("fit"), F.collect_list(F.when(full, F.col("prefix"))).alias("gone")
    )
    part = keyed.join(lists, ["doc", "h"]).select("doc", "h", "text", "hot", "fit", "gone")
    schema = "level int, prefix long, doc long, h long, at array<int>, left int, words binary"
    suffixes = part.mapInArrow(lambda it: _suffixes(it, window, lengths), schema)
    spans = clustered(suffixes, "level", "prefix").mapInArrow(lambda it: _repeats(it, window, lengths), "doc long, h long, start long, end long")
    if level == len(lengths):
        spans = spans.unionByName(part.mapInArrow(lambda it: _leaves(it, window, lengths), "doc long, h long, start long, end long"))
    return spans


def _keep(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, ...] = ([], [], [])
        for text, starts, ends in zip(*(b[c].to_pylist() for c in ("text", "starts", "ends")), strict=True):
            words = (text or b"").split()
            kept = words
            if starts:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1), np.add.at(edge, ends, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            out[0].append(len(words)), out[1].append(len(words) - len(kept)), out[2].append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 50, lengths: tuple[int, ...] = LENGTHS, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of `docs` (doc_id and text; more are ignored).

    Words are runs without ASCII white space, unchanged. A word goes if a window of `window` words around it also starts in a
    document with a smaller doc_id (null is smallest; equal ids never remove from each other). Kept words are joined by one
    space. A null text has no words. Repeated rows give repeated results; an empty table gives none.
    """
    keyed = docs.select(id_key().alias("doc"), F.col("text").cast("binary").alias("text")).select("doc", F.xxhash64("text").alias("h"), "text")
    spans = repeated_spans(keyed, window, lengths, most)
    by_doc = spans.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    by_doc = by_doc.select("doc", "h", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    # the same rows dealt out by the same keys as for the suffixes, so Spark shuffles the texts once
    joined = keyed.join(by_doc, ["doc", "h"], "left").select(from_key("doc").alias("doc_id"), "text", "starts", "ends")
    return joined.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document; windows of 50 words."""
    d = remove_repeats(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) u(i)),
lo AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN lo USING (h) WHERE doc_id > lo),
kept AS (SELECT w.doc_id, j, w[j] AS x FROM w, unnest(range(1, len(w) + 1)) u(j) ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.j = u.j),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
