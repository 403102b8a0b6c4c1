"""Byte-pair encoding with a minimal acyclic transducer of frequent units, and exact merging of all others; decoding."""

from __future__ import annotations

import functools
import json
import mmap
import struct
import tempfile
import urllib.parse
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, id_key, from_key, saved, shared_folder
from .spans import LOWER, column_bytes, gathered, portions, span_hashes, spans
from .tokens import Remembered

#: Frequent units in the lexicon at most, and bytes of each.
MOST_UNITS, MOST_BYTES = 1 << 17, 64
MAGIC = b"FSLEX01\n"

# What may be cut apart without a change: bytes 0 blank, 1 letter, 2 digit, 3 mark, 4 apostrophe, 5 all others.
_KIND = np.full(256, 5, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 4
_CUT = np.zeros((6, 6), bool)
_CUT[1, [2, 3, 4]] = _CUT[2, [1, 2, 3, 4]] = _CUT[3, [1, 2]] = True


class Merges:
    """Exact ids of one unit, from the tokenizer file's ranks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.check(spec)
        self.ids = model["vocab"]
        self.end = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}

    @staticmethod
    def check(spec: dict) -> None:
        """Units are cut by rules that hold for tokenizers of one kind; a file of another kind is an error."""
        model, kinds = spec["model"], []
        for part in ("normalizer", "pre_tokenizer"):
            kinds.append([x["type"] for x in (spec[part] or {}).get("normalizers", (spec[part] or {}).get("pretokenizers", []))])
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["continuing_subword_prefix"] or model.get("ignore_merges") or model["byte_fallback"])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex") if kinds[1] else None
        known = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: what the cutting rules were derived from
        added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        if not (plain and known and added and kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and spec["decoder"] is None):
            raise ValueError("not a tokenizer whose texts can be cut into units: encode whole texts by its library")

    def piece(self, symbols: list[str]) -> list[int]:
        """The merges of one pre-token: always the lowest rank, of equal ones the leftmost."""
        symbols[-1] += self.end
        rank, none = self.ranks.get, len(self.ranks)
        found = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while found and (least := min(found)) < none:
            at = found.index(least)
            new = symbols[at] + symbols[at + 1]
            symbols[at : at + 2] = [new]
            del found[at]
            if at:
                found[at - 1] = rank((symbols[at - 1], new), none)
            if at < len(found):
                found[at] = rank((new, symbols[at + 1]), none)
        return [self.ids[s] for s in symbols if s in self.ids]

    def pieces(self, long: list[str]) -> list[int]:
        """As :meth:`piece` for a long pre-token, whose merges cost a heap step each in place of a scan."""
        import heapq

        long[-1] += self.end
        n, ranks = len(long), self.ranks
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, long[i], long[i + 1]) for i in range(n - 1) if (r := ranks.get((long[i], long[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or long[i] != a or long[j] != b:
                continue
            long[i], live[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((long[x], long[y]))) is not None:
                    heapq.heappush(heap, (r, x, long[x], long[y]))
        return [self.ids[s] for s, alive in zip(long, live, strict=True) if alive and s in self.ids]

    def of(self, unit: bytes) -> np.ndarray:
        """Ids of one unit: runs of one kind of ASCII bytes are a pre-token; others are normalised and split by the library."""
        text = unit.decode("utf-8", "replace")
        if "<|" in text:  # may hold special tokens
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if unit.isalpha() and unit.isascii():
            split = [text.lower()]
        elif len(unit) == 1 and 0x21 <= unit[0] < 0x7F:
            split = [text]
        else:
            split = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        return np.array([i for p in split for i in (self.piece if len(p) < 100 else self.pieces)(list(p))], np.uint32)


# --------------------------------------------------------------------------------------------------- the transducer


def minimal_automaton(words: Iterable[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool], int]:
    """Arcs (byte, target) of each state, whether it ends a word, and the first state, for distinct words in byte order.

    States with the same future are one: each word's new tail is replaced by registered states as soon as the next word leaves it.
    """
    arcs: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    register: dict[tuple, int] = {}

    def settled(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            arcs.append(node[1])
            final.append(node[0])
        return state

    path: list[list] = [[False, []]]  # the states of the last word, not settled yet: [ends a word, arcs]
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settled(node)))

    for word in words:
        common = 0
        for x, y in zip(word, last):
            if x != y:
                break
            common += 1
        settle(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    settle(0)
    return arcs, final, settled(path[0])


class Lexicon:
    """A transducer in a double array: a state's arc by byte b is in slot base + b if the slot says so, and has the next state and
    an output; the outputs along a word add up to its place in byte order, where its ids are."""

    NAMES = {"base": "<i4", "check": "<i4", "target": "<i4", "out": "<i4", "final": "|b1", "offsets": "<i8", "ids": "<u4"}

    def __init__(self, raw: bytes | memoryview | mmap.mmap) -> None:
        view = memoryview(raw)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a lexicon")
        (size,) = struct.unpack("<Q", view[len(MAGIC) : len(MAGIC) + 8])
        at = len(MAGIC) + 8
        self.meta = json.loads(bytes(view[at : at + size]))
        at += size
        for name, kind in self.NAMES.items():
            n = self.meta[name] * np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(view[at : at + n], kind))
            at += n

    @classmethod
    def compile(cls, words: list[bytes], ids: list[np.ndarray]) -> bytes:
        """words: distinct, in byte order, none empty."""
        arcs, final, first = minimal_automaton(words)
        size = np.zeros(len(arcs), np.int64)  # words a state leads to
        outs = []
        for s, (own, ends) in enumerate(zip(arcs, final, strict=True)):  # targets come before their sources
            total, out = int(ends), []
            for _, t in own:
                out.append(total)
                total += int(size[t])
            size[s] = total
            outs.append(out)
        base, slots, placed = cls._place(arcs)
        check, target, out = (np.full(slots, -1, np.int32) for _ in range(3))
        for s, at in placed:
            check[at], target[at], out[at] = s, [t for _, t in arcs[s]], outs[s]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        parts = {"base": base, "check": check, "target": target, "out": out, "final": np.array(final, bool), "offsets": offsets, "ids": np.concatenate([np.empty(0, np.uint32), *ids])}
        meta = json.dumps({k: len(v) for k, v in parts.items()} | {"first": first, "longest": max(map(len, words), default=0)}).encode()
        meta += b" " * (-(len(MAGIC) + 8 + len(meta)) % 8)
        return MAGIC + struct.pack("<Q", len(meta)) + meta + b"".join(np.ascontiguousarray(v, cls.NAMES[k]).tobytes() for k, v in parts.items())

    @staticmethod
    def _place(arcs: list[list[tuple[int, int]]]) -> tuple[np.ndarray, int, list[tuple[int, np.ndarray]]]:
        """Bases such that no two arcs share a slot: states of many arcs first, each at the first place that fits."""
        base, placed = np.zeros(len(arcs), np.int32), []
        free = np.ones(512 + 2 * sum(map(len, arcs)) + 512, bool)
        free[:256] = False  # so that no base is negative
        low, failed = 256, 0
        for s in sorted((s for s, a in enumerate(arcs) if len(a) > 1), key=lambda s: -len(arcs[s])):
            own = np.array([b for b, _ in arcs[s]])
            at = max(low - int(own[0]), 0)
            while True:
                while at + 4096 + 256 > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                fits = free[at + own[0] : at + own[0] + 4096].copy()
                for b in own[1:]:
                    fits &= free[at + b : at + b + 4096]
                hit = int(np.argmax(fits))
                if fits[hit]:
                    break
                at += 4096
                failed += 1
            base[s] = at + hit
            free[at + hit + own] = False
            placed.append((s, at + hit + own))
            if failed >= 64:  # the front is full but for gaps that single arcs will take
                low, failed = max(low, at), 0
        single = [s for s, a in enumerate(arcs) if len(a) == 1]
        gaps = np.flatnonzero(free)
        if len(gaps) < len(single):
            gaps = np.append(gaps, np.arange(len(free), len(free) + len(single)))
        for s, slot in zip(single, gaps.tolist(), strict=False):
            base[s] = slot - arcs[s][0][0]
            placed.append((s, np.array([slot])))
        return base, int(max((at[-1] for _, at in placed), default=0)) + 257, placed

    def places(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each span's place among the words, or -1; all spans take a step at a time."""
        found = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= self.meta["longest"]))
        at, left = starts[live], lengths[live].astype(np.int32)
        state, place = np.full(len(live), self.meta["first"], np.int32), np.zeros(len(live), np.int32)
        while len(live):
            slot = self.base[state] + raw[at]
            ok = self.check[slot] == state
            live, at, left, slot, place = live[ok], at[ok] + 1, left[ok] - 1, slot[ok], place[ok]
            state, place = self.target[slot], place + self.out[slot]
            done = left == 0
            ends = done & self.final[state]
            found[live[ends]] = place[ends]
            go = ~done
            live, at, left, state, place = live[go], at[go], left[go], state[go], place[go]
        return found


# --------------------------------------------------------------------------------------------------------- units


def units(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, special) of all units of some texts; ASCII units have a-z for A-Z in the bytes.

    A unit is what stands between blanks, cut where two ASCII characters side by side are never in one pre-token nor change each
    other's normal form. Words with the marks of special tokens are left whole and unchanged.
    """
    kind = _KIND[raw]
    cuts = np.zeros(len(raw), bool)
    cuts[1:] = _CUT[kind[:-1], kind[1:]]
    inside = kind > 0
    rows = rows[:-1][rows[:-1] < len(raw)]
    marks = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if len(raw) > 1 else np.empty(0, np.int64)
    odd = np.zeros(len(raw), bool)
    if len(marks):
        s, e = spans(inside, rows)
        which = np.unique(np.searchsorted(s, marks, "right") - 1)
        odd[gathered(s[which], e[which] - s[which])] = True
        cuts &= ~odd
    starts, ends = spans(inside, rows, cuts)
    high = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(raw >= 0x80, out=high[1:])
    special = odd[starts]
    unchanged = special | (high[ends] > high[starts])
    low = LOWER[raw]
    back = gathered(starts[unchanged], ends[unchanged] - starts[unchanged])
    low[back] = raw[back]
    return low, starts, ends, special


def _unit_counts(batches, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """(unit, n): those of a portion are told apart by hashes, as two of one hash could only move a count, and no id depends on it."""
    seen: dict[bytes, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])

    for p in portions(batches):
        raw, starts, ends, special = units(*column_bytes(p["text"]))
        _, first, count = np.unique(span_hashes(raw, starts, ends), return_index=True, return_counts=True)
        short = ~special[first] & (ends - starts <= MOST_BYTES)[first]
        first, count, data = first[short], count[short], raw.tobytes()
        for s, e, n in zip(starts[first].tolist(), ends[first].tolist(), count.tolist(), strict=True):
            unit = data[s:e]
            seen[unit] = seen.get(unit, 0) + n
        if len(seen) > most:
            yield rows()
            seen.clear()
    if seen:
        yield rows()


def frequent_units(docs: DataFrame, most: int = MOST_UNITS) -> list[bytes]:
    """At most `most` units of the texts, in byte order: all that occur at least so often that so many do. Counts cover all texts."""
    text = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    counts = saved(text.mapInArrow(_unit_counts, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1"))
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("c")).orderBy(F.desc("step")).collect()  # 1,024 rows at most
    cut, total = None, 0
    for r in sizes:
        total += r.c
        if total > most:
            break
        cut = r.step
    if cut is None:
        return []
    return sorted(bytes(r.unit) for r in counts.where(step >= cut).select("unit").collect())


def write_lexicon(docs: DataFrame, tokenizer: str, most: int = MOST_UNITS) -> str:
    """Compiles the frequent units of `docs` (column text) and returns the file's URI in the shared folder."""
    words = frequent_units(docs, most)
    merges = _merges(tokenizer)
    raw = Lexicon.compile(words, [merges.of(w) for w in words])
    uri = shared_folder(docs.sparkSession, "lexicon")
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/lexicon") as out:
        out.write(raw)
    return f"{uri}/lexicon"


@functools.cache
def _merges(path: str) -> Merges:
    """Read once per process."""
    return Merges(path)


@functools.lru_cache(2)
def _lexicon(uri: str) -> Lexicon:
    """Mapped once per process: the file itself where it is local, else an unnamed copy."""
    parts = urllib.parse.urlparse(uri)
    if parts.scheme in ("", "file"):
        with open(urllib.parse.unquote(parts.path), "rb") as f:
            return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:
        while chunk := f.read(1 << 20):
            copy.write(chunk)
        copy.flush()
        return Lexicon(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ))


# ----------------------------------------------------------------------------------------------- encode and decode


class Encoder:
    """Ids of whole texts: units of the lexicon by the transducer, others merged and remembered."""

    def __init__(self, lexicon: Lexicon, merges: Merges, most: int = 100_000) -> None:
        self.lexicon = lexicon
        self.rest = Remembered(merges.of, most)

    def ids(self, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin and the last's end."""
        raw, starts, ends, special = units(raw, rows)
        place = self.lexicon.places(raw, starts, np.where(special, 0, ends - starts))
        unseen = np.flatnonzero(place < 0)
        data = raw.tobytes() if len(unseen) else b""
        merged = [self.rest[data[s:e]] for s, e in zip(starts[unseen].tolist(), ends[unseen].tolist(), strict=True)]
        size = self.lexicon.offsets[place + 1] - self.lexicon.offsets[np.maximum(place, 0)]
        size[unseen] = [len(x) for x in merged]
        out = np.empty(int(size.sum()), np.uint32)
        at = np.concatenate([[0], np.cumsum(size)])
        known = place >= 0
        out[gathered(at[:-1][known], size[known])] = self.lexicon.ids[gathered(self.lexicon.offsets[place[known]], size[known])]
        if merged:
            out[gathered(at[:-1][unseen], size[unseen])] = np.concatenate(merged)
        return out, at[np.searchsorted(starts, rows)]


def _encode(batches, lexicon: str, tokenizer: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(_lexicon(lexicon), _merges(tokenizer))
    for p in portions(batches, 1 << 20):
        ids, at = encoder.ids(*column_bytes(p["text"]))
        if len(ids) >= 2**29:
            raise ValueError("a text of 2^29 ids or more")
        raw = pa.Array.from_buffers(pa.binary(), p.num_rows, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
        yield pa.RecordBatch.from_arrays([p["doc"], raw], ["doc", "ids"])


def encode_bpe(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text (null: none) as little-endian unsigned 32-bit integers; a row a row.

    Equal to the library's encode without added special tokens; special tokens that stand in a text are found. Texts may be
    empty or long, ids null or repeated; other columns are ignored; an empty table gives no rows. Any lexicon gives the same ids.
    """
    rows = docs.select(id_key().alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, lexicon, tokenizer), "doc long, ids binary").select(from_key("doc").alias("doc_id"), "ids")


@functools.cache
def _token_texts(tokenizer: str) -> list[bytes]:
    t = _merges(tokenizer).tokenizer
    return [(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size(with_added_tokens=True))]


def _decode(batches, tokenizer: str) -> Iterator[pa.RecordBatch]:
    texts = _token_texts(tokenizer)
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            out = [b" ".join(map(texts.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])


def decode_bpe(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows of (doc_id, ids): the library's decode with special tokens kept, which joins the tokens of such
    a tokenizer by blanks. Null ids are none."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, tokenizer), "doc_id long, ids binary, decoded string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole document."""
    import public_tokenizers as public

    docs, tokenizer = documents(spark, sf_dir), public.path("word_bpe_49k.json")
    both = decode_bpe(encode_bpe(docs, tokenizer, write_lexicon(docs, tokenizer)), tokenizer)
    n = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return both.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
