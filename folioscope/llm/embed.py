"""Near-duplicate embeddings: binary codes after a random rotation, with correction factors, decide what is computed exactly.

1. Equal vectors form one class, whatever their ids; classes are the nodes of all steps but the last.
2. A unit vector x is rotated by a seeded orthogonal matrix; the signs of the result are its code c (entries +-1/sqrt(D)), and
   f = <c, Rx> is stored with it. For any unit q, <c, Rq> / f estimates s = <x, q> without bias, with an error of about
   sqrt((1 - s^2) (1 - f^2) / f^2 / (D - 1)); EPSILON such errors are the confidence bound.
3. Signs after further rotations, cut into `bits`, are the keys of `tables` hash tables. bits grows with log2 of the number of
   vectors, so that buckets stay small, and tables so that a pair at the threshold is missed with probability `miss` at most.
4. The tables hold codes alone, CODE signs of the first and further rotations. A member of a bucket stays if some other member's
   code differs from its own in no more places than a pair at the threshold does, but for a tenth of `miss`.
5. Members that stay get their vectors. In each bucket, estimates from codes and factors are compared with the threshold: pairs
   whose upper bound is below it are done with; the cosines of the others are computed in double precision, in the first table
   alone that holds the pair. Each bucket gives counts, and links to the least member of its groups.
6. Connected components of those links.

Buckets of any size are dealt out as tiles of two blocks in both steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import clustered, from_key, id_key, looked_up, mixed, runs, saved, tiled
from .components import components
from .minhash import _star, led

EPSILON = 4.0
BLOCK = 2048
#: Signs of a code in the tables, at least; more of them tell near vectors from others more sharply.
CODE = 256


def rotation(dim: int, seed: int, number: int = 0) -> np.ndarray:
    """A random orthogonal matrix, a function of its arguments."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def table_count(bits: int, threshold: float, miss: float) -> int:
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-p)))


def code_size(dim: int) -> int:
    return dim * max(1, -(-CODE // dim))


def most_differences(dim: int, threshold: float, miss: float) -> int:
    """The least number of places such that codes of a pair at the threshold differ in more with probability `miss` at most."""
    p, tail = math.acos(threshold) / math.pi, 1.0
    for h in range(dim + 1):
        tail -= math.comb(dim, h) * p**h * (1 - p) ** (dim - h) if dim < 1000 else 0.0
        if dim < 1000 and tail <= miss or dim >= 1000 and h >= dim * p + 5 * math.sqrt(dim * p * (1 - p)):
            return h
    return dim


class Coder:
    """Codes, factors and table keys of unit vectors of one dimension."""

    def __init__(self, dim: int, bits: int, tables: int, seed: int) -> None:
        self.first, self.size = rotation(dim, seed), code_size(dim)
        need = -(-(bits * tables + self.size - dim) // dim)
        planes = np.concatenate([rotation(dim, seed, k + 1) for k in range(max(1, need))])
        self.more, self.planes = planes[: self.size - dim], planes[self.size - dim :][: bits * tables]
        self.dim, self.bits, self.tables = dim, bits, tables

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs under the first rotation, then under the others, eight to a byte, and the factors f of the first."""
        r = x @ self.first.T
        return np.packbits(np.hstack([r, x @ self.more.T]) >= 0, axis=1), np.abs(r).sum(axis=1) / math.sqrt(self.dim)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A key per table, with the table's number and the dimension mixed in."""
        bit = (x @ self.planes.T >= 0).reshape(len(x), self.tables, self.bits)
        h = np.zeros((len(x), self.tables), np.uint64) + np.arange(1, self.tables + 1, dtype=np.uint64) + np.uint64(self.dim << 20)
        for at in range(0, self.bits, 32):
            part = bit[:, :, at : at + 32]
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + part @ (np.uint64(1) << np.arange(part.shape[2], dtype=np.uint64)))
        return h.view(np.int64)


def bounds(f: np.ndarray, dim: int, s: float = 0.0, epsilon: float = EPSILON) -> np.ndarray:
    """Half width of the confidence interval of the estimate of an inner product s from a code with factor f."""
    return epsilon * np.sqrt((1 - s * s) * np.maximum(0, 1 - f**2) / f**2 / max(1, dim - 1))


def estimates(rotated: np.ndarray, code: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Estimates of inner products: entry (i, j) uses the values of row i of `rotated` and the code and factor of j."""
    dim = rotated.shape[1]
    sign = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    return (rotated.astype(np.float32) @ sign.T) / (math.sqrt(dim) * f[None, :])


def _unit(values: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that have a direction, and their unit vectors in double precision."""
    rows, out = [], []
    for i, v in enumerate(values.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x /= top  # squares of very large and very small components stay in range
                rows.append(i), out.append(x / np.linalg.norm(x))
    return np.array(rows, np.int64), out


_CODED = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("x", pa.binary()), ("code", pa.binary()), ("f", pa.float64()), ("mult", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _encode(batches, bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    coders: dict[int, Coder] = {}
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            rows, units = _unit(part["embedding"])
            node, mult = part["node"].to_numpy(), part["mult"].to_numpy()
            for dim in sorted({len(u) for u in units}):
                here = [k for k, u in enumerate(units) if len(u) == dim]
                if dim not in coders:
                    coders[dim] = Coder(dim, bits, tables, seed)
                c = coders[dim]
                x = np.array([units[k] for k in here])
                code, f = c.code(x)
                columns = [node[rows[here]], [dim] * len(x), [r.tobytes() for r in x], [r.tobytes() for r in code], f, mult[rows[here]], list(c.keys(x))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _CODED.types, strict=True)], schema=_CODED)


def _tiles(t: pa.Table) -> Iterator[tuple[int, int]]:
    """Where each tile of a sorted table begins and ends, for those of two rows and more."""
    key, tile = t["key"].to_numpy(), t["tile"].to_numpy()
    cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), True])
    return ((int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1)


def near_codes(code: np.ndarray, most: int) -> np.ndarray:
    """Which rows have another row whose code differs in `most` places or fewer."""
    pad = np.zeros((len(code), -(-code.shape[1] // 8) * 8), np.uint8)
    pad[:, : code.shape[1]] = code
    words = pad.view(np.uint64)
    out = np.zeros(len(code), bool)
    for at in range(0, len(code), 256):
        part = words[at : at + 256]
        differ = sum(np.bitwise_count(part[:, None, w] ^ words[None, :, w]).astype(np.int32) for w in range(words.shape[1]))
        differ[np.arange(len(part)), np.arange(at, at + len(part))] = most + 1
        out[at : at + 256] = (differ <= most).any(axis=1)
    return out


def _open(batches, threshold: float, miss: float) -> Iterator[pa.RecordBatch]:
    """Members of tiles whose codes are near enough to another's."""
    most: dict[int, int] = {}
    for t in runs(batches, ["key", "tile"], 16_384):
        raw, dim = t["code"].to_pylist(), t["dim"].to_numpy()
        keep = np.zeros(len(t), bool)
        for a, b in _tiles(t):
            d = int(dim[a])  # the dimension is part of the key
            if d not in most:
                most[d] = most_differences(code_size(d), threshold, miss / 10)
            keep[a:b] = near_codes(np.frombuffer(b"".join(raw[a:b]), np.uint8).reshape(b - a, -1), most[d])
        yield t.filter(pa.array(keep)).select(["key", "tile", "blk", "nb", "node"]).combine_chunks().to_batches()[0] if keep.any() else _NONE


_NONE = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, ["key", "tile", "blk", "nb", "node"])


def links_in(x: np.ndarray, rotated: np.ndarray, code: np.ndarray, f: np.ndarray, keys: np.ndarray, key: int, mult: np.ndarray, threshold: float, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links per row that this bucket is the first to hold (a class counts `mult` vectors), and groups of linked rows.

    block: only pairs across blocks are looked at.
    """
    m, half = len(x), bounds(f, x.shape[1], threshold)  # of a pair at the threshold; above it, the interval is narrower
    table = int(np.flatnonzero((keys == key).all(axis=0))[0])
    near = np.zeros((m, m), bool)
    for at in range(0, m, 512):
        a, b = np.nonzero(estimates(rotated[at : at + 512], code, f) + half[None, :] >= threshold)
        a, b = (v[a + at < b] for v in (a + at, b))
        if block is not None:
            a, b = (v[block[a] != block[b]] for v in (a, b))
        for t in range(table):
            a, b = (v[keys[a, t] != keys[b, t]] for v in (a, b))
        for k in range(0, len(a), 65_536):
            i, j = a[k : k + 65_536], b[k : k + 65_536]
            sure = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            near[i[sure], j[sure]] = near[j[sure], i[sure]] = True
    return near @ mult, led(m, lambda r: near[r].copy())


def _exact(batches, threshold: float, seed: int) -> Iterator[pa.RecordBatch]:
    turn: dict[int, np.ndarray] = {}
    for t in runs(batches, ["key", "tile"], 2_048):
        key, tile, node, blk, nb, mult, f = (t[c].to_numpy() for c in ("key", "tile", "node", "blk", "nb", "mult", "f"))
        xs, codes, keys = (t[c].to_pylist() for c in ("x", "code", "keys"))
        out: list[list[np.ndarray]] = [[], [], []]
        for s, e in _tiles(t):
            cross = tile[s] // nb[s] != tile[s] % nb[s]
            x = np.frombuffer(b"".join(xs[s:e]), np.float64).reshape(e - s, -1)
            dim = x.shape[1]
            if dim not in turn:
                turn[dim] = rotation(dim, seed)
            code = np.frombuffer(b"".join(codes[s:e]), np.uint8).reshape(e - s, -1)
            count, group = links_in(x, x @ turn[dim].T, code, f[s:e], np.array(keys[s:e]), key[s], mult[s:e], threshold, blk[s:e] if cross else None)
            a, hub = _star(node[s:e], group)
            hubs = dict(zip(a, hub, strict=True))
            linked = np.flatnonzero(count)
            out[0].append(node[s:e][linked]), out[1].append(count[linked])
            out[2].append(np.array([hubs.get(v, v) for v in node[s:e][linked]], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.empty(0, np.int64)]), pa.int64()) for c in out], ["node", "n", "hub"])


def near_embeddings(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-4, seed: int = 2, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding; more are ignored).

    Vectors of one dimension are linked if their cosine reaches `threshold`. Null, empty and zero vectors and those with a null
    or non-finite component are linked with nothing. Rows with equal vec_id and equal embedding are one vector and give equal
    rows; rows that share a vec_id with different embeddings are vectors of their own. A null vec_id is an id that sorts first.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(e.isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(id_key("vec_id").alias("vec"), e.cast("array<double>").alias("embedding"))
    rows = rows.withColumn("c1", F.when(usable, F.xxhash64("embedding"))).withColumn("c2", F.when(usable, F.xxhash64(F.lit(seed), "embedding")))
    total = rows.count()
    bits = max(8, math.ceil(math.log2(max(2, total))) - 2)
    tables = table_count(bits, threshold, miss)
    one = rows.where("c1 is not null").groupBy("c1", "c2").agg(F.min("vec").alias("least"), F.count_distinct("vec").alias("mult"), F.any_value("embedding").alias("embedding"))
    one = saved(one.withColumn("node", F.monotonically_increasing_id()))  # numbers stay as they were saved
    coded = saved(one.mapInArrow(lambda it: _encode(it, bits, tables, seed), "node long, dim int, x binary, code binary, f double, mult long, keys array<long>"))
    members = coded.select(F.explode("keys").alias("key"), "node", "dim", "code")
    placed = tiled(members, "key", "node", block, coded.count() * tables)
    kept = saved(clustered(placed, "key", "tile").mapInArrow(lambda it: _open(it, threshold, miss), "key long, tile long, blk long, nb long, node long"))
    full = kept.join(coded.select("node", "x", "code", "f", "mult", "keys"), "node")
    found = saved(clustered(full, "key", "tile").mapInArrow(lambda it: _exact(it, threshold, seed), "node long, n long, hub long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    owned = one.select("c1", "c2", "node", "least", "mult").join(named, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    owned = saved(owned.withColumn("n", F.coalesce("n", F.lit(0)) + F.col("mult") - 1).select("c1", "c2", "least", "n", "component"))
    firsts = owned.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("n_"))
    by_class = looked_up(owned, firsts, "component", total).select("c1", "c2", "n", "first")
    out = rows.select("vec", "c1", "c2").join(by_class, ["c1", "c2"], "left")
    first = F.coalesce("first", "vec")
    return out.select(
        from_key("vec").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(first != F.lit(-(2**63)), first).alias("component_id"),
        (first == F.col("vec")).alias("kept"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector, by cosine >= 0.95 whatever the labels."""
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(embedding, embedding) > 0
), u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n, len(x) AS d FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.d = b.d AND list_dot_product(a.x, b.x) / a.n / b.n >= 0.95),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT t.vec_id, coalesce(any_value(l.n), 0) AS n_links, min(reached) AS component_id, t.vec_id = min(reached) AS kept
FROM embeddings t JOIN r ON r.node = t.vec_id LEFT JOIN l ON l.a = t.vec_id GROUP BY t.vec_id
"""
