"""Language identification: a byte-level convolutional network, trained in numpy, over batches of fixed-length windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents
from .quality import held_out

WINDOW, WIDTHS, FILTERS, BYTE_DIM = 256, (2, 3, 4, 5), 12, 8
#: Documents that the network is trained on at most, by a hash of the id, and windows of each; languages it knows at most, the most
#: frequent ones, and documents of each of them at least, if there are so many.
MOST_FIT, MOST_WINDOWS, MOST_LANGS, LEAST_EACH = 6_000, 6, 256, 20
SALTS = 256  # parts that the ids of one language are ranked in, before those left are ranked together
_REACH = max(WIDTHS)
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode category L; signs like a half or a squared are not."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def windows(text: bytes) -> np.ndarray:
    """The whole text in windows of WINDOW bytes, ASCII letters lower-cased, the last one padded with blanks.

    Neighbours overlap by the longest filter less one, so every run of bytes that a filter sees lies in a window.
    """
    step = WINDOW - _REACH + 1
    n = max(1, -(-(len(text) - _REACH + 1) // step))
    raw = np.frombuffer(text.lower().ljust((n - 1) * step + WINDOW, b" "), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[::step][:n]


class ByteNet:
    """Byte vectors, convolutions of several widths as one masked matrix, ReLU, max pooling over the window, softmax."""

    def __init__(self, langs: list[str], seed: int = 4) -> None:
        r = np.random.default_rng(seed)
        self.langs = langs
        width = np.repeat(WIDTHS, FILTERS)
        mask = np.repeat(np.arange(_REACH)[:, None] < width, BYTE_DIM, axis=0).astype(np.float32)
        self.mask = mask
        self.p = {
            "byte": r.normal(0, 0.5, (256, BYTE_DIM)).astype(np.float32),
            "conv": (r.normal(0, 1, mask.shape) / np.sqrt(width * BYTE_DIM) * mask).astype(np.float32),
            "bias": np.zeros(mask.shape[1], np.float32),
            "out": (r.normal(0, 1, (mask.shape[1], len(langs))) / np.sqrt(mask.shape[1])).astype(np.float32),
            "prior": np.zeros(len(langs), np.float32),
        }

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of every position and the convolution's output there."""
        e = self.p["byte"][x]
        n, length, d = e.shape
        view = np.lib.stride_tricks.as_strided(e, (n, length - _REACH + 1, _REACH * d), (e.strides[0], e.strides[1], e.strides[2]), writeable=False)
        columns = np.ascontiguousarray(view).reshape(-1, _REACH * d)
        return columns, (columns @ self.p["conv"]).reshape(n, length - _REACH + 1, -1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        _, c = self._pool(x)
        return np.maximum(c.max(axis=1) + self.p["bias"], 0) @ self.p["out"] + self.p["prior"]

    def log_probabilities(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        z = np.concatenate([self.logits(x[i : i + batch]) for i in range(0, len(x), batch)])
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        columns, c = self._pool(x)
        at = c.argmax(axis=1)
        top = np.take_along_axis(c, at[:, None], 1)[:, 0] + self.p["bias"]
        act = np.maximum(top, 0)
        z = act @ self.p["out"] + self.p["prior"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q *= (weight / weight.sum())[:, None]
        back = (q @ self.p["out"].T) * (top > 0)
        chosen = columns.reshape(n, -1, columns.shape[1])[np.arange(n)[:, None], at]  # (n, filters, columns)
        conv = np.einsum("nfc,nf->cf", chosen, back) * self.mask
        byte = np.zeros_like(self.p["byte"])
        into = (back[:, :, None] * self.p["conv"].T[None]).reshape(n, at.shape[1], _REACH, BYTE_DIM)
        seen = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(_REACH)]
        np.add.at(byte, seen.ravel(), into.reshape(-1, BYTE_DIM))
        return {"byte": byte, "conv": conv, "bias": back.sum(0), "out": act.T @ q, "prior": q.sum(0)}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 5) -> ByteNet:
        r = np.random.default_rng(seed)
        count = np.bincount(y, minlength=len(self.langs)).astype(np.float64)
        weight = (count.sum() / (len(count) * np.maximum(count, 1)))[y]
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            i = r.integers(0, len(x), batch)
            lr = rate * (1 - 0.9 * step / steps)
            for k, g in self.gradients(x[i], y[i], weight[i]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def fit_languages(docs: DataFrame, most: int = MOST_FIT, most_windows: int = MOST_WINDOWS, seed: int = 4) -> ByteNet | None:
    """A network from documents with text and lang, of each language those with the least seeded hash of their id; None without any.

    The MOST_LANGS most frequent languages share `most` documents evenly, but LEAST_EACH for each; the bound holds for rows,
    whatever ids repeat. Of each document at most `most_windows` windows are used, spread evenly; languages weigh equally.
    """
    usable = docs.where("text is not null and lang is not null and text <> ''")
    langs = [r.lang for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()]
    if not langs:
        return None
    each = max(LEAST_EACH, most // len(langs))
    h = F.xxhash64(F.lit(seed), "doc_id")
    mine = Window.partitionBy("lang")
    # a language's ids go to many tasks first, so that the last ranking of one has SALTS * each rows at most
    dealt = usable.where(F.col("lang").isin(langs)).select("lang", "doc_id", h.alias("h")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    few = dealt.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))).where(F.col("n") <= each)
    ids = few.withColumn("n", F.row_number().over(mine.orderBy("h", "doc_id"))).where(F.col("n") <= each)
    ids = ids.select(F.col("lang").alias("lang_"), F.col("doc_id").alias("id_")).distinct()
    rows = usable.join(F.broadcast(ids), (F.col("lang") == F.col("lang_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi").select("doc_id", "lang", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for doc, lang, text in zip(*(b[c].to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                w = windows(text)
                w = w[np.unique(np.linspace(0, len(w) - 1, most_windows).astype(int))]
                yield pa.RecordBatch.from_pydict({"doc_id": [doc], "lang": [lang], "x": [w.tobytes()]}, schema=pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())]))

    cut = rows.mapInArrow(run, "doc_id long, lang string, x binary").withColumn("n", F.row_number().over(mine.orderBy(h, "doc_id", "x"))).where(F.col("n") <= each)
    got = cut.select("doc_id", "lang", "x").toPandas().sort_values(["doc_id", "lang", "x"])
    langs = sorted(set(got["lang"]))
    each = [len(x) // WINDOW for x in got["x"]]
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([langs.index(k) for k in got["lang"]], each)
    net = ByteNet(langs, seed)
    return net.train(x, y) if len(langs) > 1 else net


def predict_languages(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the mean log probability over all windows of the whole text decides.

    A text that is null or has no letter gets ``und`` and score 0, as does everything if there was nothing to learn from.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                pred, score = ["und"] * len(part), np.zeros(len(part))
                held: list[np.ndarray] = []
                owner: list[int] = []
                total = np.zeros((len(part), len(net.langs) if net else 1))
                count = np.zeros(len(part))

                def flush(held=held, owner=owner, total=total, count=count):
                    if held:
                        each = [len(w) for w in held]
                        who = np.repeat(owner, each)
                        np.add.at(total, who, net.log_probabilities(np.concatenate(held)))
                        np.add.at(count, who, 1)
                        held.clear(), owner.clear()

                size = 0
                for i, text in enumerate(part["text"].to_pylist()):
                    if net and text and has_letter(text):
                        w = windows(text.encode())
                        for k in range(0, len(w), 4096):
                            held.append(w[k : k + 4096]), owner.append(i)
                            size += len(held[-1])
                            if size >= 4096:
                                flush()
                                size = 0
                flush()
                for i in np.flatnonzero(count):
                    z = total[i] / count[i]
                    q = np.exp(z - z.max())
                    k = int(z.argmax())
                    pred[i], score[i] = net.langs[k], q[k] / q.sum()
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from rows that are not held out."""
    docs = documents(spark, sf_dir)
    net = fit_languages(docs.where(~held_out(4, 2)))
    return predict_languages(docs, net).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
