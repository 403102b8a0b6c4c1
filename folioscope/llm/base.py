"""What the operators of this subpackage share: word hashing, batch helpers and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: no ASCII white space inside.
WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = -(2**63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_key(col: str = "doc_id"):
    """The id as a never-null long; a null id sorts before all others."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def from_key(col: str):
    """The inverse of :func:`id_key`."""
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI below spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """Makes sure that checkpoint() has a folder and returns its URI."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(set_dir)
        return set_dir
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioscope-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects its garbage, and a driver that only plans many small jobs may never do that by itself, so that
    their files would pile up to the end. Files of frames still in use stay.
    """
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products behave as random bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes, in order; empty if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    whole, done, power, width, cur = None, 0, _ODD, 1, h
    while True:  # binary powering: power == _ODD ** width, cur hashes runs of `width` words
        if k & width:
            whole = cur[:n].copy() if whole is None else whole * power + cur[done : done + n]
            done += width
        if 2 * width > k:
            return mixed(whole)
        cur = cur[: len(cur) - width] * power + cur[width:]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2


def arrow_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a slice at a time so that Python objects stay few."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], least: int, most_bytes: int = 64_000_000) -> Iterator[pa.Table]:
    """Tables of at least `least` rows, or about `most_bytes`, that never cut a run of equal keys; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        size += b.nbytes
        if count < least and size < most_bytes:
            continue
        t = pa.Table.from_batches(held)
        same = np.ones(len(t), bool)
        for k in keys:
            c = t[k].to_numpy()
            same &= c == c[-1]
        cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
            held, count = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
            size = sum(x.nbytes for x in held)
    if count:
        yield pa.Table.from_batches(held)


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, sorted by the keys."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


#: Keys that are broadcast at most, a row of a few numbers each.
HUBS = 100_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int, least: int = 100) -> DataFrame:
    """`rows` joined with `table`, which has one row per key and in n_ how many of the `total` rows have it; n_ goes.

    Keys of more than max(least, total / HUBS) rows, so HUBS at most, are looked up in place by a broadcast; rows of all other
    keys are shuffled. So a key with very many rows is no heavier in one task than others.
    """
    many = max(least, total // HUBS)
    extra = [c for c in table.columns if c not in (key, "n_")]
    hot = F.broadcast(table.where(F.col("n_") > many).select(key, F.lit(True).alias("hot_"), *extra))
    first = rows.join(hot, key, "left")
    rest = first.where("hot_ is null").select(*rows.columns).join(table.where(F.col("n_") <= many).drop("n_"), key)
    return first.where("hot_").drop("hot_").unionByName(rest)


def tiled(rows: DataFrame, key: str, node: str, block: int, total: int, size: Column | None = None) -> DataFrame:
    """`rows` with tile, blk and nb, such that any two rows of one key meet in one tile; keys of a single row go.

    A key whose sizes (1 by default) sum to `block` at most is one tile. A larger one is dealt into nb blocks by a hash of `node`, and each
    pair of blocks, and each block by itself, is a tile; (tile div nb, tile mod nb) are its blocks.
    """
    sums = rows.groupBy(key).agg(F.count("*").alias("n_"), F.sum(F.lit(1) if size is None else size).alias("s_")).where("n_ > 1")
    table = saved(sums.select(key, "n_", F.ceil(F.col("s_") / F.lit(block)).cast("long").alias("nb")))
    large = table.where(F.col("nb") > 1).limit(1).count()
    placed = looked_up(rows, table, key, total) if large else rows.join(table.select(key, "nb"), key)
    placed = placed.withColumn("blk", F.pmod(F.xxhash64(node), F.col("nb")))
    pairs = placed.withColumn("o_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    return pairs.withColumn("tile", F.greatest("blk", "o_") * F.col("nb") + F.least("blk", "o_")).drop("o_")
