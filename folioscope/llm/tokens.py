"""Token counts as an exact length histogram, and a token-id file format with Elias-Fano document boundaries."""

from __future__ import annotations

import base64
import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import compress
from operator import itemgetter, not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import arrow_rows, documents, id_key, saved, shared_folder, shuffle_partitions


class Remembered(dict):
    """Values of `new` by key, in two generations of at most `most` keys each; long keys are not kept."""

    def __init__(self, new: Callable, most: int) -> None:
        super().__init__()
        self.new, self.most, self.old = new, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.new(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


# ---------------------------------------------------------------------------------------------- exact length histogram

#: Runs of white space with two spaces in them are the only places where cutting before a space changes the result.
_TWO_SPACES = re.compile(r" \s* ")


class TokenCount:
    """Token counts of whole texts under a byte-level rank vocabulary, by space-led pieces."""

    def __init__(self, ranks: str, pattern: str, most: int = 250_000) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pieces = Remembered(lambda piece: len(self.encode(" " + piece)), most)

    def count(self, text: str) -> int:
        """Tokens of the whole text; equal to encoding it in one call."""
        if not text:
            return 0
        if _TWO_SPACES.search(text):
            return len(self.encode(text))
        head, *rest = text.split(" ")
        return (len(self.encode(head)) if head else 0) + sum(map(self.pieces.__getitem__, rest))


@functools.cache
def token_count(ranks: str, pattern: str) -> TokenCount:
    """One per worker process, so that later tasks know the pieces of earlier ones."""
    return TokenCount(ranks, pattern)


def _counts(batches, ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = token_count(ranks, pattern)
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.count(t or "") for (t,) in arrow_rows([b])], pa.int64())], ["n_tokens"])


def length_histogram(docs: DataFrame, ranks: str, pattern: str, width: int = 4096) -> DataFrame:
    """One row per encoded length: n_tokens, n_docs, docs_ge and tokens_ge (documents at least as long, and their tokens),
    docs_lt, tokens_lt, truncated_total (tokens kept if every document is cut to n_tokens).

    ``docs`` needs a column text; others are ignored. Null and empty texts have length 0; an empty table gives no rows. The
    suffix sums run inside blocks of `width` lengths after a sum per block, so no task holds all lengths.
    """
    hist = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _counts(it, ranks, pattern), "n_tokens long")
    hist = saved(hist.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn("block", F.floor(F.col("n_tokens") / width).cast("long"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    block = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    block = block.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = hist.join(block, "block").withColumn("docs_ge", F.col("d_after") + F.sum("n_docs").over(inside)).withColumn("tokens_ge", F.col("t_after") + F.sum(tokens).over(inside))
    return out.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (F.col("d_all") - F.col("docs_ge")).alias("docs_lt"),
        (F.col("t_all") - F.col("tokens_ge")).alias("tokens_lt"),
        (F.col("t_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, kept_tokens, cut_docs) for context limits that need not be lengths of the histogram."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    kept = F.sum(F.least("n_tokens", "context") * F.col("n_docs"))
    cut = F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0))
    sums = F.broadcast(asked).join(histogram.select("n_tokens", "n_docs"), F.lit(True), "left").groupBy("context")
    return sums.agg(F.coalesce(kept, F.lit(0)).alias("kept_tokens"), F.coalesce(cut, F.lit(0)).alias("cut_docs"))


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length such that at least the share q of all documents is no longer; None over an empty table."""
    row = histogram.where((F.col("docs_lt") + F.col("n_docs")) >= F.lit(q) * (F.col("docs_lt") + F.col("docs_ge"))).agg(F.min("n_tokens")).first()
    return row[0]


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents under a public byte-level vocabulary."""
    import public_tokenizers as public

    return length_histogram(documents(spark, sf_dir), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


# ------------------------------------------------------------------------------------------------------- id files

MAGIC = b"FSIDS01\n"
_SAMPLE = 512  # a select sample stands for so many values


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(u / n) bits a value, with sampled select on the upper bits."""

    HEAD = struct.Struct("<QQB7x")

    def __init__(self, raw: bytes | memoryview) -> None:
        self.n, self.top, self.low_bits = self.HEAD.unpack_from(raw)
        at = self.HEAD.size
        sizes = self.sizes(self.n, self.top, self.low_bits)
        self.low, self.high, samples = (np.frombuffer(raw, np.uint8, s, at + sum(sizes[:i])) for i, s in enumerate(sizes))
        self.samples = samples.view("<u4")

    @staticmethod
    def sizes(n: int, top: int, low_bits: int) -> tuple[int, int, int]:
        return (n * low_bits + 7) // 8, (n + (top >> low_bits) + 8) // 8, 4 * ((n + _SAMPLE - 1) // _SAMPLE)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        if n + (top >> low_bits) >= 2**32:
            raise ValueError("too many values for one file; use more files")
        low_size, high_size, _ = cls.sizes(n, top, low_bits)
        low = np.zeros(low_size, np.uint8)
        for at in range(0, n, 1 << 16):  # a multiple of 8, so that each slice fills whole bytes
            part = v[at : at + (1 << 16), None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
            packed = np.packbits(part.astype(np.uint8).ravel(), bitorder="little")
            low[at * low_bits // 8 : at * low_bits // 8 + len(packed)] = packed
        place = (v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(high_size, np.uint8)
        np.bitwise_or.at(high, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        return cls.HEAD.pack(n, top, low_bits) + low.tobytes() + high.tobytes() + place[::_SAMPLE].astype("<u4").tobytes()

    def _lows(self, i: int, j: int) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(j - i, np.uint64)
        first = i * b // 8
        bits = np.unpackbits(self.low[first : (j * b + 7) // 8], bitorder="little")[i * b - 8 * first :][: (j - i) * b]
        return bits.reshape(-1, b).astype(np.uint64) @ (np.uint64(1) << np.arange(b, dtype=np.uint64))

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, read from the nearest sample on."""
        if j <= i:
            return np.empty(0, np.uint64)
        s = i // _SAMPLE
        start = int(self.samples[s]) // 8
        end = int(self.samples[(j - 1) // _SAMPLE + 1]) // 8 + 1 if (j - 1) // _SAMPLE + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + 8 * start
        ones = ones[ones >= int(self.samples[s])][i - s * _SAMPLE : j - s * _SAMPLE]
        return ((ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i, j)

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


class TokenFile:
    """Reads one file: MAGIC, ids, boundaries (Elias-Fano), document ids (Elias-Fano), footer (JSON), its length, MAGIC."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        (length,) = struct.unpack("<Q", tail[:8])
        self.meta = json.loads(self.file.read_at(length, size - 8 - len(MAGIC) - length))
        m = self.meta
        self.dtype = np.dtype(f"<u{m['width']}")
        at = len(MAGIC) + m["n_ids"] * m["width"]
        self.ends = EliasFano(self.file.read_at(m["ends_size"], at))
        self.docs = EliasFano(self.file.read_at(m["docs_size"], at + m["ends_size"]))

    def __len__(self) -> int:
        return self.meta["n_docs"]

    def offsets(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 begin, and where the last ends."""
        ends = self.ends.slice(max(i - 1, 0), j).astype(np.int64)
        return ends if i else np.r_[0, ends]

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        nulls = self.meta["n_null"]
        ids = self.docs.slice(max(i - nulls, 0), max(j - nulls, 0)) + np.uint64(self.meta["base"] % 2**64)
        return [None] * max(0, min(j, nulls) - i) + ids.view(np.int64).tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        w = self.meta["width"]
        return np.frombuffer(self.file.read_at((end - start) * w, len(MAGIC) + start * w), self.dtype)


#: Characters whose words are encoded alone: white space that is dropped, what may begin an added token, and all past Latin-1.
_ALONE = re.compile("[\u0085\u00a0<\u0100-\U0010ffff]")


class Cores:
    """Ids of words by Tokenizer.encode, in two generations of at most `most` words met last.

    Words of Latin-1 characters, which the normaliser would only lower-case, pass by it where :func:`_cut_at_marks` knows it. They are
    encoded many at a time, blanks between them; the bytes that ids stand for tell whose ids are whose, or the library's offsets, which
    take it longer, where those do not add up to the words. Others, whose normal form may have other lengths, are texts of their own
    in a batch.
    """

    def __init__(self, tokenizer: str, width: int, most: int = 500_000) -> None:
        self.tokenizer, self.dtype = _tokenizer(tokenizer), np.dtype(f"<u{width}")
        self.most, self.new, self.old = most, {}, {}
        self.plain = _cut_at_marks(tokenizer)
        self.sizes = _token_bytes(tokenizer) if self.plain else None
        self.bare = _without_normalizer(tokenizer) if self.plain else None

    def _together(self, words: list[bytes], text: str, tokenizer) -> Iterator[bytes]:
        cut = None
        if self.sizes is not None:
            (e,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(e.ids, self.dtype)
            at, end = np.append(0, np.cumsum(self.sizes[ids])), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            cut = np.searchsorted(at, end)
            if at[-1] != end[-1] or (at[cut] != end).any():
                cut = None
        if cut is None:
            e = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(e.ids, self.dtype)
            begin = np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e.ids))
            cut = np.searchsorted(begin, np.cumsum(np.fromiter((len(w.decode()) for w in words), np.int64, len(words)) + 1))
        raw, w = ids.tobytes(), self.dtype.itemsize
        cut = [0, *(w * cut).tolist()]
        return map(raw.__getitem__, map(slice, cut[:-1], cut[1:]))

    def _learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if w.isascii()]
        low = [w for w in plain if b"<" not in w] if self.bare else []
        for tokenizer, some in ((self.bare, low), (self.tokenizer, [w for w in plain if b"<" in w] if self.bare else plain)):
            for at in range(0, len(some), 1 << 15):
                part = some[at : at + (1 << 15)]
                self.new.update(zip(part, self._together(part, b" ".join(part).decode(), tokenizer), strict=True))
        others = [(w, w.decode("utf-8", "replace")) for w in words if not w.isascii()]
        alone = [_ALONE.search(t) is not None for _, t in others]
        latin = list(compress(others, map(not_, alone)))
        for at in range(0, len(latin), 1 << 15):
            part = latin[at : at + (1 << 15)]
            mine, text = [w for w, _ in part], " ".join(t for _, t in part)
            self.new.update(zip(mine, self._together(mine, text.lower() if self.bare else text, self.bare or self.tokenizer), strict=True))
        rest = list(compress(others, alone))
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for (word, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                self.new[word] = np.array(e.ids, self.dtype).tobytes()

    def parts(self, words: list[bytes]) -> tuple[list[bytes], dict[int, bytes]]:
        """Each word without the mark behind it, and the marks by the word's place; the ids of a word are those of both in turn."""
        if not self.plain:
            return words, {}
        marks = {i: w[-1:] for i, w in enumerate(words) if w.endswith((b",", b".")) and w[-2:-1].isalpha()}
        words = words.copy()
        for i in marks:
            words[i] = words[i][:-1]
        return [w.lower() if w.isascii() and b"<" not in w else w for w in words], marks

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        if len(self.new) > self.most:  # what has not been met since the last turn goes
            self.old, self.new = self.new, {}
        cores, marks = self.parts(words)
        new = {b"", *cores, *marks.values()}.difference(self.new)
        known = new.intersection(self.old)
        self.new.update(zip(known, map(self.old.__getitem__, known), strict=True))
        self._learn(list(new - known))
        out = list(map(self.new.__getitem__, cores))
        for i, mark in marks.items():
            out[i] += self.new[mark]
        return out


@functools.cache
def _cores(tokenizer: str, width: int) -> Cores:
    """One per worker process, so that later tasks know the words of earlier ones."""
    return Cores(tokenizer, width)


class WordIds:
    """Ids of whole texts by Tokenizer.encode, called once for each word that is not remembered.

    A word is what stands between ASCII white space. Cutting there changes nothing for a tokenizer that drops white space, splits
    by a pattern that never crosses it and normalises without looking across it. Where :func:`_cut_at_marks` allows it, a word is
    looked up without the comma or full stop behind an ASCII letter, and ASCII words in lower case. Words as they stand and what
    was encoded are both remembered by the worker process, see :func:`_word_ids`.
    """

    def __init__(self, tokenizer: str, width: int, most: int = 250_000) -> None:
        self.cores, self.most, self.new, self.old = _cores(tokenizer, width), most, {}, {}

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        if len(self.new) > self.most:  # two generations: what has not been met since the last turn goes
            self.old, self.new = self.new, {}
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.new)
        known = new.intersection(self.old)
        self.new.update(zip(known, map(self.old.__getitem__, known), strict=True))
        fresh = list(new - known)
        self.new.update(zip(fresh, self.cores.of(fresh), strict=True))
        return (b"".join(map(self.new.__getitem__, words)) for words in split)


@functools.cache
def _word_ids(tokenizer: str, width: int) -> WordIds:
    """One per worker process, so that later tasks know the words of earlier ones as they stand."""
    return WordIds(tokenizer, width)


def _portions(batches, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows of (doc, text) in runs of about `most` bytes of text."""
    for b in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


@functools.cache
def _tokenizer(path: str):
    """Read once per worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _without_normalizer(path: str):
    """The tokenizer for texts that its normaliser would leave as they are."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_str(json.dumps(json.load(f) | {"normalizer": None}))


@functools.cache
def _cut_at_marks(path: str) -> bool:
    """Whether the tokenizer is of the kind that lower-cases after composing, and never keeps a letter and a mark together."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [[x["type"] for x in (spec[part] or {}).get(part + "s", (spec[part] or {}).get("pretokenizers", []))] for part in ("normalizer", "pre_tokenizer")]
    pattern = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex") if kinds[1] else None
    known = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: what the rule was derived from
    added = all(x["content"].startswith("<") and not x["normalized"] and not re.search("[,.]", x["content"]) for x in spec["added_tokens"])
    return known and added and kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]


@functools.cache
def _token_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id of a byte-level vocabulary stands for: a character of a token is a byte."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    suffix = spec["model"].get("end_of_word_suffix") or ""
    out = np.zeros(_tokenizer(path).get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in spec["model"]["vocab"].items():
        out[i] = len(token.removesuffix(suffix))
    for x in spec["added_tokens"]:
        out[x["id"]] = len(x["content"].encode())
    return out


def id_width(tokenizer: str) -> int:
    return 2 if _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) <= 2**16 else 4


def _write(batches, folder: str, tokenizer: str, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """One file per task, in the order of its rows; a repeated attempt writes another file and only one is listed."""
    from pyspark import TaskContext

    portions = (p for p in _portions(batches) if p.num_rows)
    portion = next(portions, None)
    if portion is None:
        return
    system, root = fs.FileSystem.from_uri(folder)
    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
    system.create_dir(root, recursive=True)
    words, end = _word_ids(tokenizer, width), np.array([end_id], f"<u{width}").tobytes()
    lengths, keys = [], []
    try:
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC)
            while portion is not None:
                for raw in words.of([t or b"" for t in portion["text"].to_pylist()]):
                    out.write(raw + end)
                    lengths.append(len(raw) // width + 1)
                keys.append(portion["doc"].to_numpy())
                portion = next(portions, None)
            ends = np.cumsum(np.array(lengths, np.int64))
            key = np.concatenate(keys)
            nulls = int((key == -(2**63)).sum())
            base = int(key[nulls]) if nulls < len(key) else 0
            parts = [EliasFano.encode(ends), EliasFano.encode(key[nulls:].view(np.uint64) - np.uint64(base % 2**64))]
            meta = {"n_docs": len(key), "n_ids": int(ends[-1]), "n_null": nulls, "base": base, "width": width, "ends_size": len(parts[0]), "docs_size": len(parts[1])}
            footer = json.dumps(meta).encode()
            out.write(b"".join(parts) + footer + struct.pack("<Q", len(footer)) + MAGIC)
    except BaseException:
        try:
            system.delete_file(f"{root}/{name}")
        except OSError:
            pass
        raise
    yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": f"{folder}/{name}", "n_docs": meta["n_docs"], "n_ids": meta["n_ids"]}])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, files: int | None = None) -> DataFrame:
    """Writes token files in ascending doc_id order (null first, equal ids by a hash of the text) and returns their list:
    part, file, n_docs, n_ids and start (ids in all files before).

    Null and empty texts are documents of the end id alone. Rows are kept one by one, repeated ones too; an empty table gives no
    files. The list has a row per file; it is also written to `folder`/manifest and only files in it count.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key().alias("doc"), F.col("text").cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    width = id_width(tokenizer)
    spread = rows.repartitionByRange(files or shuffle_partitions(spark), "doc", "h").sortWithinPartitions("doc", "h").select("doc", "text")
    spread.mapInArrow(lambda it: _write(it, folder, tokenizer, width, end_id), "part long, file string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    listed = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches, block: int) -> Iterator[pa.RecordBatch]:
    for file, start in arrow_rows(batches):
        f = TokenFile(file)
        for i in range(0, len(f), block):
            j = min(i + block, len(f))
            at = f.offsets(i, j)
            crcs = []
            k = 0
            while k < j - i:  # ids are read in runs of documents of a bounded size
                m = max(k + 1, int(np.searchsorted(at, at[k] + (1 << 21), "right")) - 1)
                ids = f.ids(int(at[k]), int(at[m])).astype("<u4")
                crcs += [zlib.crc32(ids[at[x] - at[k] : at[x + 1] - at[k]]) for x in range(k, m)]
                k = m
            columns = [pa.array(f.doc_ids(i, j), pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(listed: DataFrame, block: int = 8192) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, read back from the files; start counts the ids of all files before."""
    spark = listed.sparkSession
    files = listed.select("file", "start").repartition(shuffle_partitions(spark), "file")
    return files.mapInArrow(lambda it: _read(it, block), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, public.path("word_bpe_49k.json"), end_id=1))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files in the shared folder, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files(documents(spark, sf_dir))
