"""Operator 13: centroid clustering with float32 screening and exact decisions.

Vectors are integers (floor of ``SCALE`` times each component), so every distance, sum and centroid is exact.  In a round a task
multiplies a block of its vectors by all centroids in float32.  The rounding error of such a product is at most
g * |x| * |c| with g = n*u / (1 - n*u), u = 2**-24, for n additions in any order; with this bound each distance becomes an interval.
Centroids whose interval begins above the least end are out.  Where one is left it is the nearest; where
several are, their distances are computed in 64-bit integers, and the lowest number wins a tie.  A task returns counts and
sums of each cluster, which are added per cluster and component before the few new centroids reach the driver.

Defined results: vectors of another width, with a null or non-finite component, or null, are dropped; a component of 2**27 or more as an
integer raises an error, as its distances exceed 64 bits; vectors with a null id are clustered and start no cluster
unless nothing else can; repeated rows count as often as they occur, and of equal hashes the least vector starts; fewer vectors than
clusters give fewer clusters; an empty cluster keeps its centroid; sums of distances beyond 64 bits show as the greatest long; an empty
table gives no row; other columns are not read; there is no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, written

SCALE = 1024
WIDTH = 64
CLUSTERS = 8
ROUNDS = 10
#: Vectors of a block, and numbers of the matrix of a block and all centroids.
ROWS = 8192
CELLS = 4 << 20
LIMIT = 1 << 27
LONG_MAX = 2**63 - 1
ULP = 2.0**-24


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): kept vectors as little-endian 32-bit integers."""
    arrow_batches(vectors.sparkSession, ROWS)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            if not len(x):
                continue
            real = x.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
            ok = np.isfinite(real).all(axis=1)
            with np.errstate(over="ignore"):
                whole = np.floor(real[ok] * scale)
            if (np.abs(whole) >= LIMIT).any():
                raise ValueError(f"a component is {LIMIT} or more as an integer: its distances exceed 64 bits")
            rows = np.ascontiguousarray(whole.astype("<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "v"])

    right = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.size("x") == width)
    return right.mapInArrow(take, "vec_id long, v binary")


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, rounded up."""
    return np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + 2.0**-40) + 2.0**-40


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, rows that were decided by exact integers) of integer vectors, exactly."""
    n, k, width = len(x), len(centroids), x.shape[1]
    xf, cf = x.astype(np.float64), centroids.astype(np.float64)
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    # Conversion to float32 (two roundings of a half unit), n products and sums, and the few double operations below.
    g = (width + 4) * ULP / (1 - (width + 4) * ULP)
    own, other = norms(xf), norms(cf)
    rest = np.einsum("ij,ij->i", cf, cf)
    middle = rest[None, :] - 2 * product
    half = 2 * g * own[:, None] * other[None, :] + (rest[None, :] + 2 * np.abs(product)) * 2.0**-44 + 2.0**-40
    left = middle - half <= (middle + half).min(axis=1)[:, None]
    out = np.argmax(left, axis=1)
    several = np.flatnonzero(left.sum(axis=1) > 1)
    if len(several):
        best = np.full(len(several), LONG_MAX, np.int64)
        pick = np.zeros(len(several), np.int64)
        for j in range(k):  # ascending, so an equal distance never replaces a lower number
            rows = np.flatnonzero(left[several, j])
            d = exact(x[several[rows]], centroids[j])
            better = d < best[rows]
            best[rows[better]], pick[rows[better]] = d[better], j
        out[several] = pick
    distance = np.zeros(n, np.int64)
    for j in range(k):
        rows = np.flatnonzero(out == j)
        distance[rows] = exact(x[rows], centroids[j])
    return out, distance, len(several)


def exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - centroid.astype(np.int64)
    return np.einsum("ij,ij->i", d, d)


def _matrices(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    rows = max(1, min(ROWS, CELLS // max(k, 1)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, width)


def starts(kept: DataFrame, k: int = CLUSTERS, salt: str = "3:", width: int = WIDTH) -> np.ndarray:
    """The vectors with the k smallest hashes of ``salt`` and id, in ascending order."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.select("v", name.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in rows], np.int64).reshape(-1, width)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of exact means; empty clusters stay."""
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, total = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
        for _, x in _matrices(batches, width, k):
            out, _, _ = assign(x, centroids)
            for j in np.unique(out):
                sums[j] += x[out == j].sum(axis=0, dtype=np.int64)
            counts += np.bincount(out, minlength=k)
            total += len(x)
            if total > 1 << 34:  # below 2**61 in any component
                yield _sums(counts, sums)
                sums, counts, total = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
        if total:
            yield _sums(counts, sums)

    parts = kept.mapInArrow(add, "cluster int, place int, total long")
    after = centroids.copy()
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
    for j, sums in found.items():
        after[j] = [sums[i] // sums[-1] for i in range(width)]
    return after


def _sums(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Rows (cluster, place, total); place -1 has the count."""
    own = np.flatnonzero(counts)
    width = sums.shape[1]
    place = np.tile(np.arange(-1, width), len(own))
    total = np.concatenate([counts[own, None], sums[own]], axis=1).reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, width + 1).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total)], ["cluster", "place", "total"])


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) after the last round, the centroids)."""
    kept = written(quantised(vectors, id_col, vector_col, width, scale), "vectors")
    centroids = starts(kept, k, salt, width)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        before, centroids = centroids, moved(kept, centroids)
        if (before == centroids).all():
            break  # every further round would do the same

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, width, len(centroids)):
            out, distance, _ = assign(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return written(kept.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters"), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    per = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(per.values()), LONG_MAX)
    told = [(j, min(d, LONG_MAX), whole, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in per.items()]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
