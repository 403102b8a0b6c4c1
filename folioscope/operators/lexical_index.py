"""A stored lexical index: postings in blocks with their greatest weights, so that a query skips blocks that cannot reach its k best.

Documents are indexed where they lie: each task cuts its documents into blocks, a bounded number of which are a run, and writes the
postings of all of them, its part, run by run and there sorted by term, as one file of one row group. So building shuffles no postings,
a task of a search holds the asked postings of one run at a time, whatever its part's size, Parquet's page index leads it to the terms
that are asked for, and scores are added up in place. What is shuffled is k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .shared import saved

#: Documents of a block.
BLOCK = 1024
#: Blocks of a run, and its words if that is less: what a search holds at a time.
RUN_BLOCKS, RUN_WORDS = 16, 2_000_000
#: Questions that one pass over the index answers.
MOST_QUESTIONS = 2_000


_SCHEMAS = {
    "postings": "part int, run int, block int, term string, n int, best double, ids array<long>, weights array<double>",
    "terms": "term string, idf double",
    "documents": "id long",
}


@dataclass
class LexicalIndex:
    """postings: part, run, block, term, n, best, ids, weights; terms: term, idf; documents: id. Weights are without the idf."""

    folder: str

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.schema(_SCHEMAS[table]).parquet(f"{self.folder}/{table}")


def _postings(batches, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    """A row a term of each block of `size` documents: rows of (id, w) come, w the words of a document."""
    from pyspark import TaskContext

    part, run, block, in_run = TaskContext.get().partitionId(), 0, 0, 0
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # ids, numbers of words, words
    count = size_of_words = 0

    def rows() -> pa.RecordBatch:
        words = pa.concat_arrays([x for *_, x in held]).dictionary_encode()
        codes, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        ids, dl = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        pair, tf = np.unique(code * len(ids) + np.repeat(np.arange(len(ids)), dl), return_counts=True)
        term, doc = np.divmod(pair, len(ids))
        w = weight(tf, dl[doc])
        first = np.searchsorted(term, np.arange(len(codes)))
        offsets = pa.array(np.append(first, len(term)).astype(np.int32))
        n = np.diff(np.append(first, len(term)))
        lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids[doc], w))
        same = (pa.array(np.full(len(codes), x, np.int32)) for x in (part, run, block))
        best = np.maximum.reduceat(w, first) if len(first) else w
        return pa.RecordBatch.from_arrays([*same, codes.cast(pa.string()), pa.array(n.astype(np.int32)), pa.array(best), *lists], ["part", "run", "block", "term", "n", "best", "ids", "weights"])

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal run, block, in_run, count, size_of_words
        if in_run and (block % RUN_BLOCKS == 0 or in_run + size_of_words > RUN_WORDS):
            run, in_run = run + 1, 0
        yield rows()
        block, in_run = block + 1, in_run + size_of_words
        held.clear()
        count = size_of_words = 0

    for b in batches:
        lengths = pc.fill_null(pc.list_value_length(b["w"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, words, total = b["id"].to_numpy(), b["w"].flatten(), np.append(0, np.cumsum(lengths))
        at = 0
        while at < b.num_rows:
            # up to the block's last document, or to the one that makes it long
            long = int(np.searchsorted(total, total[at] + 1000 * size - size_of_words))
            to = max(at + 1, min(b.num_rows, at + size - count, long))
            held.append((ids[at:to], lengths[at:to], words.slice(total[at], total[to] - total[at])))
            count, size_of_words, at = count + to - at, size_of_words + int(total[to] - total[at]), to
            if count == size or size_of_words >= 1000 * size:
                yield from closed()
    if count:
        yield from closed()


def build_postings(corpus: DataFrame, folder: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tokenize=tokens, block: int = BLOCK) -> LexicalIndex:
    """Writes the index of `corpus` (id long, text) below `folder`, ids being distinct.

    A first pass counts words, a second one writes postings; document frequencies are sums over blocks. A term in over half of the
    documents has `epsilon` times the mean idf of the vocabulary in place of a negative one. A posting list has at most `block`
    documents, whatever the term, and a block fewer where they are very long.
    """
    spark = corpus.sparkSession
    words = corpus.select("id", tokenize(F.col("text")).alias("w"))
    sizes = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl")).first()
    n, avgdl = sizes.n, sizes.avgdl or 1.0
    corpus.select("id").write.parquet(f"{folder}/documents")

    def weight(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    rows = words.mapInArrow(lambda it: _postings(it, weight, block), _SCHEMAS["postings"])
    rows.sortWithinPartitions("run", "term", "block").write.option("parquet.block.size", 1 << 30).parquet(f"{folder}/postings")
    index = LexicalIndex(folder)
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = saved(index.read(spark, "postings").groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", raw))
    mean = terms.agg(F.avg("idf")).first()[0] or 0.0
    terms.select("term", F.when(F.col("idf") < 0, F.lit(mean * epsilon)).otherwise(F.col("idf")).alias("idf")).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    return index


class _Best:
    """The k best (score, id) of each question so far: scores rounded and descending, then ids."""

    def __init__(self, k: int) -> None:
        self.k, self.of = k, {}

    def floor(self, q: int) -> float:
        kept = self.of.get(q, ())
        return -kept[-1][0] if len(kept) == self.k else -np.inf

    def put(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        near = np.round(scores, 9)
        pick = np.lexsort((ids, -near))[: self.k]
        self.of[q] = sorted([*self.of.get(q, ()), *zip((-near[pick]).tolist(), ids[pick].tolist(), strict=True)])[: self.k]


def _score_part(lists: dict[int, dict[str, tuple]], asked: list[dict[str, float]], by_term: dict[str, list[int]], best: _Best) -> int:
    """Scores one run's blocks for every question, those with the greatest bounds first; returns how many were skipped."""
    bounds: dict[int, list[tuple[float, int]]] = {}
    for block, terms in lists.items():
        sums: dict[int, float] = {}
        for term, (top, _, _) in terms.items():
            for q in by_term[term]:
                sums[q] = sums.get(q, 0.0) + max(0.0, asked[q][term] * top)
        for q, bound in sums.items():
            bounds.setdefault(q, []).append((bound, block))
    skipped = 0
    for q, found in bounds.items():
        found.sort(reverse=True)
        for i, (bound, block) in enumerate(found):
            if bound < best.floor(q) - 1e-8:
                skipped += len(found) - i
                break
            terms = lists[block]
            mine = [(c, *terms[t][1:]) for t, c in asked[q].items() if t in terms]
            ids, at = np.unique(np.concatenate([x for _, x, _ in mine]), return_inverse=True)
            best.put(q, ids, np.bincount(at, np.concatenate([c * w for c, _, w in mine])))
    return skipped


def _search(batches, sent, k: int) -> Iterator[pa.RecordBatch]:
    qids, asked = sent.value
    by_term: dict[str, list[int]] = {}
    for q, terms in enumerate(asked):
        for t in terms:
            by_term.setdefault(t, []).append(q)
    best, run, lists = _Best(k), None, {}
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            rows = b.slice(at, 1024)
            ids, weights = rows["ids"], rows["weights"]
            places = zip(*(rows[c].to_pylist() for c in ("part", "run")), strict=True)
            for i, (now, term, block, top) in enumerate(zip(places, *(rows[c].to_pylist() for c in ("term", "block", "best")), strict=True)):
                if now != run:
                    _score_part(lists, asked, by_term, best)
                    run, lists = now, {}
                if term in by_term:  # copies, as a view would keep its whole batch
                    lists.setdefault(block, {})[term] = (top, np.array(ids[i].values), np.array(weights[i].values))
    _score_part(lists, asked, by_term, best)
    rows = [(qids[q], who, -s) for q, kept in best.of.items() for s, who in kept]
    columns = list(zip(*rows, strict=True)) or [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "id", "score"])


def _question_blocks(queries: DataFrame, index: LexicalIndex, tokenize, most: int) -> Iterator[tuple[list[int], list[dict[str, float]]]]:
    """Questions with the weights of their terms, `most` at a time; a term counts as often as it stands in the question."""
    asked = queries.select("qid", F.explode(tokenize(F.col("qtext"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("n"))
    known = asked.join(index.read(queries.sparkSession, "terms"), "term").select("qid", "term", (F.col("n") * F.col("idf")).alias("c"))
    per = saved(known.groupBy("qid").agg(F.collect_list(F.struct("term", "c")).alias("t")))
    held: list = []
    for r in per.toLocalIterator():
        held.append((r.qid, {x.term: x.c for x in r.t}))
        if len(held) == most:
            yield [q for q, _ in held], [t for _, t in held]
            held = []
    if held:
        yield [q for q, _ in held], [t for _, t in held]


def postings_topk(queries: DataFrame, index: LexicalIndex, k: int, tokenize: Column = tokens, most: int = MOST_QUESTIONS) -> DataFrame:
    """(qid, id, score, rank): the k best documents of each question (qid, qtext) by BM25, by score and then id.

    Documents without a term of the question fill up in the order of their ids. Questions without text or known terms have only such
    rows. A block whose greatest weights do not add up to a task's k-th score is not scored.
    """
    spark = queries.sparkSession
    out = spark.createDataFrame([], "qid long, id long, score double")
    postings = index.read(spark, "postings")
    for qids, asked in _question_blocks(queries, index, tokenize, most):
        sent = spark.sparkContext.broadcast((qids, asked))
        terms = sorted({t for x in asked for t in x})
        rows = postings.where(F.col("term").isin(terms)).select("part", "run", "term", "block", "best", "ids", "weights")
        out = out.unionByName(rows.mapInArrow(lambda it, sent=sent: _search(it, sent, k), "qid long, id long, score double"))
    rest = queries.select("qid").distinct().crossJoin(F.broadcast(index.read(spark, "documents").select("id").orderBy("id").limit(2 * k)))  # 2k ids
    both = out.withColumn("hit", F.lit(True)).unionByName(rest.select("qid", "id", F.lit(0.0).alias("score"), F.lit(False).alias("hit")))
    one = both.groupBy("qid", "id").agg(F.max_by("score", "hit").alias("score"), F.max("hit").alias("hit"))
    top = one.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hit"), F.desc("score"), "id"))).where(F.col("rank") <= k)
    return top.select("qid", "id", "score").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
