"""Phrase collocations: depth-bounded suffix automata per shard, counts reduced globally, subsumption along suffix links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, looked_up, mixed, saved, shuffle_partitions
from .spans import LOWER, column_bytes, cut_out, portions, span_hashes, spans

#: Words of a shard, under 75 bytes of memory each.
SHARD_WORDS = 5 << 20
#: Places that are worked on at a time where whole shards need not be.
STEP = 1 << 18
#: Bits of the map of pairs and triples that may be frequent: 16 MB. A fuller map lets more rare phrases be counted; it loses none.
MAP_BITS = 27
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)  # 0: inside a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _grouped(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of the distinct keys in their order, the number of each place's key among them, and their counts, as np.unique
    gives them. keys: 0 to `below` - 1 as int64, which are overwritten where a key and its place fit into 64 bits."""
    n, shift = len(keys), len(keys).bit_length()
    if below << shift >= 1 << 63:
        return tuple(x.astype(np.int32) for x in np.unique(keys, return_index=True, return_inverse=True, return_counts=True)[1:])
    keys <<= shift
    for at in range(0, n, STEP):
        keys[at : at + STEP] |= np.arange(at, min(n, at + STEP))
    keys.sort()
    place = np.empty(n, np.int32)
    np.bitwise_and(keys, (1 << shift) - 1, out=place, casting="unsafe")
    keys >>= shift
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new).astype(np.int32)
    number = np.empty(n, np.int32)
    number[place] = np.cumsum(new, dtype=np.int32) - 1
    return place[starts], number, np.diff(starts, append=np.int32(n))


class SuffixAutomaton:
    """A generalised suffix automaton over word codes, of the phrases of at most `depth` words.

    Its suffix links form the trie of the reversed phrases, so it is built from that side, all places at once: a node of depth d is
    the word on its left and the node of depth d - 1 with the same end, its suffix link. `levels[d - 1]` has a value each node: `end`
    (a place where it ends), `count` (its end positions), `link`, and `shortest`, the words of the shortest suffix with the same end
    positions. Nodes of the same end positions are one state; `states` gives the longest of each, which stands for the others.
    """

    def __init__(self, words: np.ndarray, reach: np.ndarray, depth: int) -> None:
        """words: a code of each place, not negative; reach: the words of the longest phrase that may end there."""
        first, code, count = _grouped(words.astype(np.int64), int(words.max(initial=0)) + 1)
        self.levels = [{"end": first, "count": count, "link": np.zeros(len(first), np.int32), "shortest": np.ones(len(first), np.int32)}]
        left, width = code, len(first)
        ends = np.arange(len(words), dtype=np.int32)
        for d in range(2, depth + 1):
            longer = reach[ends] >= d
            ends, code = ends[longer], code[longer]
            below = self.levels[-1]
            keys = code.astype(np.int64)
            keys *= width
            keys += left[ends - (d - 1)]
            first, number, count = _grouped(keys, width * len(below["end"]))
            del keys
            link = code[first]
            shortest = np.where(below["count"][link] == count, below["shortest"][link], d).astype(np.int32)
            self.levels.append({"end": ends[first], "count": count, "link": link, "shortest": shortest})
            code = number

    def states(self, d: int) -> np.ndarray:
        """The nodes of depth d that no longer node shares its end positions with."""
        longest = np.ones(len(self.levels[d - 1]["count"]), bool)
        if d < len(self.levels):
            up = self.levels[d]
            longest[up["link"][self.levels[d - 1]["count"][up["link"]] == up["count"]]] = False
        return np.flatnonzero(longest)


class _Shard:
    """Hashes of about as many words as asked for (with the language), whether each follows the one before it in its piece, and if
    asked for the words of each language and their hashes, languages and bytes, once for each portion that has them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.count, self.totals, self.named = 0, {}, []

    def put(self, p: pa.RecordBatch, seed: int, named: bool) -> None:
        raw, rows = column_bytes(p["text"])
        kind = _KIND[raw]
        starts, ends = spans(kind == 0, rows[:-1][rows[:-1] < len(raw)])
        if not len(starts):
            return
        low = LOWER[raw]
        row = np.searchsorted(rows, starts, "right") - 1
        langs = p["lang"].to_pylist()
        own = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed) for x in langs], np.uint64)
        broken = np.cumsum(kind == 2, dtype=np.int32)[starts]
        joined = np.zeros(len(starts), bool)
        joined[1:] = (broken[1:] == broken[:-1]) & (row[1:] == row[:-1])
        h = mixed(span_hashes(low, starts, ends) * _ODD + own[row])
        self.parts.append((h, joined))
        self.count += len(h)
        if not named:
            return
        for i, n in zip(*np.unique(row, return_counts=True), strict=True):
            self.totals[langs[i]] = self.totals.get(langs[i], 0) + int(n)
        some = np.unique(h, return_index=True)[1]
        self.named.append((h[some], pa.array([langs[i] for i in row[some]], pa.string()), cut_out(low, starts[some], ends[some])))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes, and which of them follow another; they are handed over."""
        whole = tuple(np.concatenate([x[i] for x in self.parts]) for i in (0, 1))
        self.parts.clear()
        return whole

    def names(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Hashes of the words in ascending order, with the language and the bytes of where each stands first."""
        h, first = np.unique(np.concatenate([x[0] for x in self.named]), return_index=True)
        lang, word = (pa.concat_arrays([x[i] for x in self.named]).take(pa.array(first)) for i in (1, 2))
        self.named.clear()
        return h, lang, word


def _shards(batches, seed: int, most: int, named: bool = False) -> Iterator[_Shard]:
    """Shards of about `most` words, with words' names if asked for."""
    shard = _Shard()
    for p in portions(batches):
        shard.put(p, seed, named)
        if shard.count >= most:
            yield shard
            shard = _Shard()
    if shard.count:
        yield shard


def _key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys of each word together with what ends before it; the first is of no use."""
    return mixed(np.roll(before, 1) * _ODD ^ h)


def _frequent(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _triples(bits: np.ndarray, h: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a place ends a pair that may be frequent, and two of them in a row; and the keys of three words."""
    pair = _key(h, h)
    two = joined & _frequent(bits, pair)
    three = two.copy()
    three[1:] &= two[:-1]
    three[:1] = False
    return two, three, _key(pair, h)


def _overlapping(h: np.ndarray, joined: np.ndarray, before: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Both in slices of STEP places, with `before` places in front of them, or what there is; the third is how many."""
    for at in range(0, len(h), STEP):
        lo = max(0, at - before)
        yield h[lo : at + STEP], joined[lo : at + STEP], at - lo


def _codes(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each of `h` in the ascending `hashes`."""
    return np.concatenate([np.searchsorted(hashes, h[at : at + STEP]).astype(np.int32) for at in range(0, len(h), STEP)])


def _fixed(values: np.ndarray) -> pa.BinaryArray:
    """The rows of a matrix of 8-byte numbers as a binary column."""
    n, d = values.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 8 * d * n + 1, 8 * d, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _rows(key: pa.Array, n, lang: pa.Array | None = None, word: pa.Array | None = None) -> pa.RecordBatch:
    nulls = pa.nulls(len(key))
    return pa.RecordBatch.from_arrays([key, lang or nulls.cast(pa.string()), word or nulls.cast(pa.binary()), pa.array(n, pa.int64())], ["key", "lang", "word", "n"])


def _spelled(tree: SuffixAutomaton, words: np.ndarray, hashes: np.ndarray, least: int, depth: int) -> Iterator[pa.RecordBatch]:
    """The phrases of `least` to `depth` words: each state's longest and its suffixes with the same end positions."""
    for d in range(least, depth + 1):
        level, every = tree.levels[d - 1], tree.states(d)
        for at in range(0, len(every), 1 << 16):
            s = every[at : at + (1 << 16)]
            whole = np.stack([hashes[words[level["end"][s] - k]] for k in range(d - 1, -1, -1)], axis=1)
            for m in range(least, d + 1):
                has = np.ones(len(s), bool) if m == d else level["shortest"][s] <= m
                yield _rows(_fixed(whole[has, d - m :]), level["count"][s[has]])


def _long_counts(h: np.ndarray, reach: np.ndarray, least: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Phrases of `least` to `depth` words of a shard; reach: the words of the longest one that ends at each place."""
    reach[reach < least] = 1
    need = np.zeros(len(h), bool)
    for k in range(min(depth, len(h))):
        need[: len(h) - k] |= reach[k:] > max(k, 1)
    some = np.flatnonzero(need)  # a phrase's words stay neighbours
    del need
    if not len(some):
        return
    h, reach = h[some], reach[some]
    del some
    hashes = np.unique(h)
    words = _codes(hashes, h)
    del h
    yield from _spelled(SuffixAutomaton(words, reach, depth), words, hashes, least, depth)


def _upper_counts(batches, seed: int, most: int, shared: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(key, lang, word, n) of the words and word pairs of each shard; with a map of the pairs that are frequent, of three words in which
    both pairs are. key is the hashes of a phrase's words, 8 bytes each. lang and word are given for single words; an empty key has
    all words of a language."""
    for shard in _shards(batches, seed, most, shared is None):
        if shared is not None:
            h, joined = shard.words()
            reach = np.concatenate([np.where(_triples(shared.value, part, follows)[1], 3, 1)[skip:].astype(np.int8) for part, follows, skip in _overlapping(h, joined, 3)])
            del joined
            yield from _long_counts(h, reach, 3, 3)
            continue
        totals = shard.totals
        yield _rows(pa.array([b""] * len(totals), pa.binary()), list(totals.values()), pa.array(list(totals), pa.string()))
        hashes, lang, word = shard.names()
        h, joined = shard.words()
        words = _codes(hashes, h)
        del h
        tree = SuffixAutomaton(words, joined.astype(np.int8) + 1, 2)
        for at in range(0, len(hashes), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield _rows(_fixed(hashes[part, None]), tree.levels[0]["count"][part], lang[part], word[part])
        yield from _spelled(tree, words, hashes, 2, 2)


def _reach(bits: np.ndarray, h: np.ndarray, joined: np.ndarray, depth: int) -> np.ndarray:
    """The words of the longest phrase that ends at each place and has only words, pairs and triples that may be frequent."""
    out = np.empty(len(h), np.int32)
    at = 0
    for part, follows, skip in _overlapping(h, joined, depth):
        two, three, keys = _triples(bits, part, follows)
        three &= _frequent(bits, keys)
        place = np.arange(len(part))
        since = place - np.maximum.accumulate(np.where(three, -1, place))  # triples in a row, up to `depth` of them
        reach = np.minimum(depth, np.where(three, 2 + since, 1 + two))[skip:]
        out[at : at + len(reach)] = reach
        at += len(reach)
    return out


def _exact_counts(batches, seed: int, most: int, depth: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """The same of the phrases of 4 to `depth` words in which all pairs and triples may be frequent."""
    for shard in _shards(batches, seed, most):
        h, joined = shard.words()
        reach = _reach(shared.value, h, joined, depth).astype(np.int8)
        del joined
        yield from _long_counts(h, reach, 4, depth)


def _shared_hashes(counted: DataFrame) -> DataFrame:
    """Hashes that stand for two words, or for words of two languages."""
    return counted.where("word is not null").groupBy("key").count().where("count > 1")


def _keys(batches) -> Iterator[pa.RecordBatch]:
    """The keys of :func:`_triples` of pairs and longer phrases, of their words' hashes."""
    for b in batches:
        sizes = pc.binary_length(b["key"])
        for size in pc.unique(sizes).to_pylist():
            h = column_bytes(b["key"].filter(pc.equal(sizes, size)))[0].view(np.uint64).reshape(-1, size // 8)
            key = h[:, 0]
            for k in range(1, size // 8):
                key = mixed(key * _ODD ^ h[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])


def _map(phrases: DataFrame, map_bits: int) -> np.ndarray:
    """A bit for each phrase's key, modulo 2^map_bits."""
    bit = F.col("key").bitwiseAND(F.lit(2**map_bits - 1))
    keys = phrases.select("key").mapInArrow(_keys, "key long")
    parts = keys.select(F.bitmap_bucket_number(bit + 1).alias("at"), F.bitmap_bit_position(bit + 1).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(max(2**map_bits // 8, 4096), np.uint8)
    for r in parts.collect():  # 2^map_bits / 2^15 rows of 4 KB at most
        bits[(r.at - 1) * 4096 : r.at * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits[: 2**map_bits // 8]


def phrase_counts(docs: DataFrame, depth: int = 4, least: int = 30, most_words: int = SHARD_WORDS, map_bits: int = MAP_BITS) -> DataFrame:
    """(key, lang, word, n): every phrase of at most `depth` words with n >= `least` occurrences; see :func:`_upper_counts`.

    A phrase is sent once by each shard that has it, in one of three passes: words and pairs; three words in which both pairs reach
    `least`; longer ones in which all triples do. Pairs and triples that do set bits of a map of 2^`map_bits`, which is all that is
    broadcast; a fuller map lets more rare phrases be counted and loses none. Words are told apart by 64-bit hashes; if two words
    share one, all is done again under another seed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def summed(counts: Callable) -> DataFrame:
        # keys of a shard are distinct already, so a map of them before the shuffle would only fill memory
        found = rows.mapInArrow(counts, "key binary, lang string, word binary, n long").repartition(2 * shuffle_partitions(spark), "key")
        return saved(found.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("lang").isNotNull()))

    for seed in range(8):
        low = summed(lambda it, seed=seed: _upper_counts(it, seed, most_words, None))
        if _shared_hashes(low).limit(1).count():
            continue
        counted = low.where((F.col("n") >= least) | (F.length("key") == 0)).where(F.length("key") <= 8 * depth)
        if depth > 2:
            bits = _map(counted.where("length(key) = 16"), map_bits)
            shared = spark.sparkContext.broadcast(bits)
            three = summed(lambda it, seed=seed, shared=shared: _upper_counts(it, seed, most_words, shared))
            shared.unpersist()
            counted = counted.unionByName(three)
        if depth > 3:
            shared = spark.sparkContext.broadcast(bits | _map(three, map_bits))
            counted = counted.unionByName(summed(lambda it, seed=seed, shared=shared: _exact_counts(it, seed, most_words, depth, shared)))
            shared.unpersist()
        return counted
    raise RuntimeError("words share 64-bit hashes under eight seeds")


_SCORE = "(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"


def _wide(x: str):
    return F.col(x).cast("decimal(20,0)")


def collocations(docs: DataFrame, depth: int = 4, least: int = 30, share: int = 80, top: int = 2000, most_words: int = SHARD_WORDS, map_bits: int = MAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `depth` words.

    Texts (null: empty) are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and into words at blanks and tabs; a null
    lang is `und`. A phrase with a >= `least` occurrences scores floor(2000000 a / (l + r)) at its lowest-scoring cut, the earliest
    of equal ones. It is left out if a phrase one word longer, its extension, has at least `share` % of its occurrences: extensions
    lie on suffix links (a word less on the left) and prefixes, and no longer phrase has more occurrences than the extension inside
    it. Order: score and a descending, then the phrase's bytes. Repeated rows count repeatedly; ids are not used; other columns are
    ignored; an empty table gives no rows.
    """
    counted = phrase_counts(docs, depth, least, most_words, map_bits)
    words = F.length("key") / 8
    grams = counted.where("length(key) > 0").select("key", F.col("n").alias("f"))
    phrases = grams.where("length(key) >= 16").select("key", F.col("f").alias("a"), words.cast("int").alias("len"))

    longer = phrases.where("len > 2").select("a", F.explode(F.array(F.expr("substring(key, 9)"), F.expr("substring(key, 1, 8 * (len - 1))"))).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("above"))
    left = phrases.join(longer, "key", "left").where(F.col("above").isNull() | (_wide("above") * 100 < _wide("a") * share)).select("key", "a", "len")
    left = saved(left)
    total = left.count()

    cuts = left.select("key", "a", F.explode(F.expr("sequence(1, len - 1)")).alias("k"))
    parts = cuts.select("key", "a", "k", F.posexplode(F.array(F.expr("substring(key, 1, 8 * k)"), F.expr("substring(key, 8 * k + 1)"))).alias("side", "part"))
    asked = parts.groupBy("part").agg(F.count("*").alias("n_"))
    table = saved(asked.join(grams.withColumnRenamed("key", "part"), "part"))
    found = looked_up(parts, table, "part", 6 * total)
    sides = found.groupBy("key", "a", "k").agg(F.sum(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.sum(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    scored = sides.withColumn("score", F.expr(_SCORE))
    best = scored.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("key", "a", "b.score", "b.l", "b.r")

    spelled = best.select("key", F.posexplode(F.expr("transform(sequence(0, cast(length(key) / 8 as int) - 1), i -> substring(key, 8 * i + 1, 8))")).alias("at", "one"))
    names = counted.where("word is not null").select(F.col("key").alias("one"), "lang", F.col("word").cast("string").alias("word"))
    table = saved(spelled.groupBy("one").agg(F.count("*").alias("n_")).join(names, "one"))
    texts = looked_up(spelled, table, "one", 4 * total).groupBy("key").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    rows = best.join(texts.select("key", "lang", F.array_join("w.word", " ").alias("phrase")), "key")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(256)))  # a language's rows go to many tasks first
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = counted.where("length(key) = 0").select("lang", "n")
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score over all documents."""
    return collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(u.piece, '[^\x20\x09]+') AS w FROM d, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) u(piece)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM p, unnest([1, 2, 3, 4]) s(k), unnest(range(1, len(w) - k + 2)) u(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k > 1 AND f >= 30),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS above FROM c, unnest([2, 3]) s(m), unnest(range(1, k - m + 2)) u(i) WHERE m < k GROUP BY ALL),
cut AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
  FROM c, unnest(range(1, k)) u(j)
  JOIN g x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN g y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(w[j + 1:], ' ')
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS b FROM cut),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE b.b = 1 AND (above IS NULL OR 100 * above < 80 * a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
