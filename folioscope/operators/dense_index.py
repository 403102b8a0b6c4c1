"""Nearest neighbours through an inverted file: vectors stored by the cell of their nearest centroid, queries read few cells.

A cell is a partition folder, so cells that no query probes are never opened. Each cell keeps the widest angle between its centroid
and its vectors; by the triangle inequality on the sphere that bounds the similarity of anything in it, which is how an exact search
decides which further cells it has to read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import MOST_QUERIES, _best, _query_blocks, _scored, unit

#: Cells at most, so that centroids (cells x dimension numbers) may be broadcast.
MOST_CELLS = 4096
_FOUND = "qid long, collection string, id long, sim double, cell int"
_UNIT = 1 << 20  # coordinates of unit vectors are summed as integers, so that sums do not depend on the order of rows


@dataclass
class DenseIndex:
    """centroids: one unit row a cell; angles: the widest angle of each cell's vectors, -1 for an empty cell."""

    folder: str
    centroids: np.ndarray
    angles: np.ndarray

    def vectors(self, spark: SparkSession, cells: list[int]) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/vectors").where(F.col("cell").isin(cells))

    def nearest_cells(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The non-empty cells of each query in descending order of similarity to the centroid, `probes` at most."""
        sim = np.where(self.angles >= 0, q @ self.centroids.T, -np.inf)
        some = int((self.angles >= 0).sum())
        return np.argsort(-sim, axis=1, kind="stable")[:, : min(probes, some)]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No vector of a cell is more similar to the query than this."""
        apart = np.arccos(np.clip(q @ self.centroids.T, -1, 1))
        return np.where(self.angles >= 0, np.cos(np.maximum(apart - self.angles, 0)), -np.inf)


def _cell(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sim = x @ centroids.T
    cell = sim.argmax(axis=1)
    return cell, np.arccos(np.clip(sim[np.arange(len(x)), cell], -1, 1))


def fit_centroids(corpus: DataFrame, cells: int, rounds: int = 6, sample: int = 100_000, seed: int = 7) -> np.ndarray:
    """Spherical k-means over a sample of about `sample` rows, drawn by a hash of the id. Zero and null vectors have no part in it.

    The first centroids are the rows of the smallest hashes. Sums are of integers and made per partition, so the centroids are the
    same for any partitioning; k rows a round reach the driver.
    """
    spark = corpus.sparkSession
    usable = corpus.where(F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False))).select("id", "vec")
    total = usable.count()
    if not total:
        return np.empty((0, 0))
    order = F.xxhash64(F.lit(seed), "id")
    share = min(1.0, sample / total)
    drawn = usable.where(F.pmod(order, F.lit(1 << 30)) <= int(share * (1 << 30)))
    first = drawn.select(order.alias("h"), "vec").orderBy("h", "vec").limit(min(cells, MOST_CELLS)).collect()
    centroids = unit(np.array([r.vec for r in first], np.float64))
    k, dim = centroids.shape
    rows = drawn.select(F.lit("").alias("collection"), "id", "vec")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, dim), np.int64)
            for _, _, x in _scored(batches):
                np.add.at(total, _cell(x, sent.value)[0], np.rint(x * _UNIT).astype(np.int64))
            used = np.flatnonzero(total.any(axis=1))
            cell, at = np.repeat(used, dim), np.tile(np.arange(dim), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[used].ravel())], ["cell", "at", "s"])

        moved = np.zeros((k, dim))
        for r in rows.mapInArrow(sums, "cell int, at int, s long").groupBy("cell", "at").agg(F.sum("s").alias("s")).collect():
            moved[r.cell, r.at] = r.s
        sent.unpersist()
        centroids = np.where(moved.any(axis=1)[:, None], unit(moved), centroids)
    return centroids


def build_index(corpus: DataFrame, folder: str, cells: int | None = None, **fit) -> DenseIndex:
    """Writes all rows of `corpus` (id, collection, vec; null vectors are left out) below `folder`, a partition folder a cell.

    cells: the square root of the row count by default, MOST_CELLS at most. Large cells are split over tasks and files.
    """
    spark = corpus.sparkSession
    rows = corpus.where("vec is not null").select("collection", "id", "vec")
    cells = min(MOST_CELLS, cells or max(1, round(rows.count() ** 0.5)))
    centroids = fit_centroids(rows, cells, **fit)
    if not len(centroids):  # nothing but zero vectors, which are equally far from any centroid
        width = rows.select(F.max(F.size("vec"))).first()[0] or 1
        centroids = np.eye(1, width)
    sent = spark.sparkContext.broadcast(centroids)

    def assigned(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = unit(np.array(part["vec"].to_pylist(), np.float64).reshape(part.num_rows, -1))
                cell, angle = _cell(x, sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(angle), pa.array(cell.astype(np.int32))], [*part.schema.names, "angle", "cell"])

    kind = rows.schema["vec"].dataType.simpleString()
    placed = rows.mapInArrow(assigned, f"collection string, id long, vec {kind}, angle double, cell int")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/vectors")
    widest = spark.read.parquet(f"{folder}/vectors").groupBy("cell").agg(F.max("angle").alias("angle")).collect() if rows.limit(1).count() else []
    angles = np.full(len(centroids), -1.0)
    for r in widest:
        angles[r.cell] = r.angle + 1e-7  # more than rounding takes from an arc cosine
    stored = [(c, v.tolist(), float(a)) for c, (v, a) in enumerate(zip(centroids, angles, strict=True))]
    spark.createDataFrame(stored, "cell int, centre array<double>, angle double").coalesce(1).write.parquet(f"{folder}/centroids")
    return DenseIndex(folder, centroids, angles)


def open_index(spark: SparkSession, folder: str) -> DenseIndex:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()
    return DenseIndex(folder, np.array([r.centre for r in rows]), np.array([r.angle for r in rows]))


def _read(spark: SparkSession, index: DenseIndex, block: list, wanted: np.ndarray, k: int) -> DataFrame:
    """(qid, collection, id, sim, cell): per task the k best for each query of the block out of the cells that it wants (a row a query)."""
    sent = spark.sparkContext.broadcast((np.array([q for q, _ in block], np.int64), unit(np.array([v for _, v in block], np.float64)), wanted))

    def found(batches) -> Iterator[pa.RecordBatch]:
        qid, q, wanted = sent.value
        best: dict[int, list] = {}
        for b in batches:
            cells = b["cell"].to_numpy()
            for c in np.unique(cells):
                mine, asking = b.filter(pa.array(cells == c)), np.flatnonzero(wanted[:, c])
                for names, ids, x in _scored([mine]):
                    by_id = np.argsort(ids, kind="stable")  # so that of equal similarities the smaller ids stay
                    names, ids, x = names[by_id], ids[by_id], x[by_id]
                    sim, at = _best(q[asking] @ x.T, np.broadcast_to(np.arange(len(ids)), (len(asking), len(ids))), k)
                    for i, s, j in zip(asking.tolist(), sim, at, strict=True):
                        kept = best.setdefault(i, [])
                        kept.extend(zip((-np.round(s, 9)).tolist(), ids[j].tolist(), s.tolist(), names[j].tolist(), [int(c)] * len(j), strict=True))
                        kept.sort(key=itemgetter(0, 1))
                        del kept[k:]
        rows = [(int(qid[i]), name, who, s, c) for i, kept in best.items() for _, who, s, name, c in kept]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["qid", "collection", "id", "sim", "cell"])

    cells = np.flatnonzero(wanted.any(axis=0)).tolist()
    return index.vectors(spark, cells).select("collection", "id", "vec", "cell").mapInArrow(found, _FOUND)


def index_topk(queries: DataFrame, index: DenseIndex, k: int, probes: int | None = None, exact: bool = False, most: int = MOST_QUERIES) -> DataFrame:
    """(qid, collection, id, sim, cell, rank): the k most similar rows by similarity and then id, out of the `probes` nearest cells.

    probes: a quarter of the cells by default. With exact, the k-th similarity found in them rules out cells by their bounds, and
    those that are left are read too, so that rows are those of a search of all vectors. Queries (qid, qvec) without a vector have no
    rows. An index without vectors gives none.
    """
    spark = queries.sparkSession
    out = spark.createDataFrame([], _FOUND)
    if not (index.angles >= 0).any():
        return out.withColumn("rank", F.lit(1))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 9)), "id")
    for block in _query_blocks(queries, most):
        q = unit(np.array([v for _, v in block], np.float64))
        wanted = np.zeros((len(block), len(index.angles)), bool)
        np.put_along_axis(wanted, index.nearest_cells(q, probes or max(1, len(index.angles) // 4)), True, axis=1)
        near = _read(spark, index, block, wanted, k)
        if exact:
            near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n").cache()
            last = {r.qid: r.s for r in near.groupBy("qid").agg(F.count("*").alias("c"), F.min("sim").alias("s")).where(F.col("c") == k).collect()}  # a row a query
            floor = np.array([last.get(qid, -np.inf) for qid, _ in block])
            more = (index.bounds(q) >= floor[:, None] - 1e-8) & ~wanted & (index.angles >= 0)
            first = spark.createDataFrame(near.collect(), _FOUND)  # k rows a query of the block at most
            near.unpersist()
            near = first.unionByName(_read(spark, index, block, more, k)) if more.any() else first
        out = out.unionByName(near)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probes_for(corpus: DataFrame, index: DenseIndex, k: int, recall: float = 0.95, sample: int = 200, seed: int = 11) -> int:
    """The fewest cells to probe so that `recall` of the k nearest rows are in them, measured by exact searches for `sample` rows of
    the corpus, drawn by a hash of the id."""
    drawn = corpus.where("vec is not null").orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample)
    asked = drawn.select(F.monotonically_increasing_id().alias("qid"), F.col("vec").alias("qvec")).collect()
    if not asked:
        return 1
    queries = corpus.sparkSession.createDataFrame([(r.qid, [float(x) for x in r.qvec]) for r in asked], "qid long, qvec array<double>")
    order = index.nearest_cells(unit(np.array([r.qvec for r in asked], np.float64)), len(index.angles))
    place = {r.qid: {c: i for i, c in enumerate(cells)} for r, cells in zip(asked, order.tolist(), strict=True)}
    needed = sorted(place[r.qid][r.cell] + 1 for r in index_topk(queries, index, k, exact=True).collect())
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]


def cells_read(index: DenseIndex, probes: int) -> float:
    """The share of non-empty cells that a query reads."""
    some = int((index.angles >= 0).sum())
    return min(probes, some) / some
