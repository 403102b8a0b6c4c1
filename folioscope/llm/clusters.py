"""Plain Lloyd iterations over integer vectors: exact distances, sums and centroids, whatever the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import saved

#: Components are below this in magnitude, so that squared distances over up to 2^14 components stay below 2^63.
MOST = 2**23


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of exactly `dim` finite components as floor(scale * x), x as double; all other vectors are left out.

    A component of 2^23 / scale or more in magnitude is an error, as squared distances would leave 64 bits.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.coalesce(F.size("embedding") == dim, F.lit(False)) & F.coalesce(finite, F.lit(False)))
    small = F.lit(float(MOST))
    whole = F.transform(e, lambda x: F.when(F.abs(x * scale) < small, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `<seed>:<vec_id>`; null ids last, equal hashes by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number and squared distance of each row's nearest centroid, the lowest number of equally near ones."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for c, centre in enumerate(centroids):  # a centroid at a time, so memory does not grow with their number
        d = x - centre
        d = np.einsum("ij,ij->i", d, d)
        closer = d < best
        best[closer], at[closer] = d[closer], c
    return at, best


def _slices(frames, rows: int = 8192) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for f in frames:
        for at in range(0, len(f), rows):
            part = f.iloc[at : at + rows]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each non-empty centroid becomes floor(sum / count) of its vectors, by components; empty ones stay."""
    k, dim = centroids.shape
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        seen = 0
        for _, x in _slices(frames):
            at, _ = nearest(x, shared.value)
            count += np.bincount(at, minlength=k)
            for c in np.unique(at):
                total[c] += x[at == c].sum(axis=0)
            seen += len(x)
            if seen > 2**38:  # sums below 2^61
                yield pd.DataFrame({"cluster": np.arange(k, dtype=np.int32), "n": count, "s": list(total)})
                total, count, seen = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], "s": list(total[used])})

    parts = kept.mapInPandas(sums, "cluster int, n long, s array<long>")
    wide = F.array(*(F.sum(F.col("s")[i].cast("decimal(20,0)")) for i in range(dim)))
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), wide.alias("s")).collect():  # k rows at most
        out[r.cluster] = [int(x) // r.n for x in r.s]
    shared.unpersist()
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def rows(frames) -> Iterator[pd.DataFrame]:
        for part, x in _slices(frames):
            at, d = nearest(x, shared.value)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": at, "distance": d})

    return kept.mapInPandas(rows, "vec_id long, cluster int, distance long")


def lloyd(vectors: DataFrame, dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of `vectors` (vec_id, embedding).

    Null vectors, those of another length, and those with null or non-finite components are left out (:func:`integer_vectors`).
    With fewer than k vectors there are as many centroids as vectors; none gives no rows. Repeated rows and ids are vectors of
    their own; equally near centroids: the lowest number. Other columns are ignored. Only centroids and their sums, k rows of `dim`
    numbers, reach the driver.
    """
    kept = integer_vectors(vectors, dim, scale)
    centroids = first_centroids(kept, k, seed)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(kept, centroids)
    names = [(c, ",".join(map(str, row))) for c, row in enumerate(centroids.tolist())]
    final = kept.sparkSession.createDataFrame(names, "cluster int, components string")
    out = saved(assigned(kept, centroids)) if len(centroids) else kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    clusters = out.groupBy("cluster").agg(exact.alias("s"))
    whole = clusters.agg(F.sum("s").cast("long").alias("inertia"))
    clusters = clusters.join(final, "cluster").select("cluster", F.col("s").cast("long").alias("cluster_inertia"), F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"))
    return out.join(F.broadcast(clusters.crossJoin(whole)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of all usable embeddings: 16 centroids, 3 rounds."""
    return lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _lloyd_sql(rounds: int, k: int, dim: int) -> str:
    near = "SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM v, m{i} m) GROUP BY r"
    # floor of a quotient, for negative sums too
    means = "SELECT c, list(q ORDER BY j) AS x FROM (SELECT c, j, CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END AS q FROM (SELECT a.c, j, sum(v.x[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} a JOIN v USING (r), unnest(range(1, {d} + 1)) u(j) GROUP BY a.c, j)) GROUP BY c"
    parts = [
        f"t AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0)",
        "v AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda z: floor(64 * z::DOUBLE)::HUGEINT) AS x FROM t)",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        if i < rounds:
            parts.append(f"m{i + 1} AS MATERIALIZED (WITH g AS ({means.format(i=i, d=dim)}) SELECT o.c, coalesce(g.x, o.x) AS x FROM m{i} o LEFT JOIN g USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN m{rounds} m USING (c)"""


OP12_SQL = _lloyd_sql(3, 16, 64)
