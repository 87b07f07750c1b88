"""Clustering around centroids in whole numbers: centroids sorted by norm, and only those of a vector's annulus compared."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Components a vector must have, parts of one that are told apart, centroids, and rounds before the last assignment.
DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"


def plain(dim: int) -> int:
    """Components below this keep every squared distance within 62 bits; larger ones are reckoned as Python integers."""
    return int(math.sqrt(2**62 / max(dim, 1)) / 2)


def whole(vectors: pa.ChunkedArray | pa.Array, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count (dim components, none null or not finite), and floor(scale * x) of theirs, a row each."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    counts = np.asarray(vectors.value_lengths().fill_null(-1)) == dim
    x = vectors.filter(pa.array(counts)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
    finite = np.isfinite(x).all(axis=1)
    counts[np.flatnonzero(counts)[~finite]] = False
    x = x[finite]
    if x.size and np.abs(x).max() * scale >= plain(dim) - 1:
        return counts, np.array([[math.floor(v * scale) if abs(v) < 2**52 else int(v) * scale for v in row] for row in x.tolist()], dtype=object).reshape(-1, dim)
    return counts, np.floor(x * scale).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1).astype(np.float64))


def distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid."""
    gap = x - centroid
    return (gap * gap).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each row's nearest centroid (ties: the smaller number), and how many were compared.

    No centroid whose norm differs from the row's by more than its distance to any one centroid can be the nearest. That one
    is the centroid of the closest norm; the others within the annulus are found by binary search in the sorted norms. The
    annulus is widened beyond what rounding could take from it, so that centroids on its border, ties too, are compared.
    """
    if centroids.dtype == object or x.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
    length, of = norms(x), norms(centroids)
    order = np.argsort(of, kind="stable")
    ranked = of[order]
    after = np.clip(np.searchsorted(ranked, length), 1, len(order) - 1) if len(order) > 1 else np.zeros(len(x), dtype=np.int64)
    probe = np.where(np.abs(ranked[after] - length) < np.abs(ranked[after - 1] - length), after, after - 1) if len(order) > 1 else after
    gap = x - centroids[order[probe]]
    best, number = (gap * gap).sum(axis=1), order[probe]
    bound = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (length + bound + (ranked[-1] if len(ranked) else 0)) + 1e-6
    low, high = np.searchsorted(ranked, length - bound - slack, side="left"), np.searchsorted(ranked, length + bound + slack, side="right")
    compared = len(x)
    for rank, c in enumerate(order):
        at = np.flatnonzero((low <= rank) & (rank < high) & (probe != rank))
        if not len(at):
            continue
        compared += len(at)
        d = distances(x[at], centroids[c])
        closer = (d < best[at]) | ((d == best[at]) & (c < number[at]))
        best[at[closer]], number[at[closer]] = d[closer], c
    return number, best, compared


def _starts(vectors: DataFrame, k: int, seed: str, dim: int, scale: int) -> np.ndarray:
    """The k counting vectors with the smallest SHA-256 of seed:id; equal ids in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    v = F.col("v").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    found = vectors.where((F.size("v") == dim) & finite).select(digest.alias("h"), v.alias("v")).orderBy("h", "v").limit(k).collect()
    return whole(pa.array([r["v"] for r in found], pa.list_(pa.float64())), dim, scale)[1]


def _moved(vectors: DataFrame, centroids: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """Each centroid's mean of its vectors, rounded down; one without vectors stays. A task sends a row a centroid and component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(centroids), dim), dtype=object), [0] * len(centroids)
        for batch in batches:
            _, x = whole(batch.column(0), dim, scale)
            own, _, _ = nearest(x, centroids) if len(x) else (np.zeros(0, dtype=np.int64), None, 0)
            for c in np.unique(own):
                total[c] += x[own == c].sum(axis=0).astype(object)  # fewer than 2^36 rows a batch: no overflow
                n[c] += int((own == c).sum())
        rows = [(c, i, total[c][i], n[c]) for c in range(len(centroids)) if n[c] for i in range(dim)]
        columns = [list(x) for x in zip(*rows, strict=True)] or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["c", "i", "s", "n"])

    parts = vectors.select("v").mapInArrow(sums, "c int, i int, s decimal(38,0), n long")
    found = parts.groupBy("c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # len(centroids) * dim rows at most
    moved = centroids.astype(object)
    for r in found:
        moved[r["c"], r["i"]] = int(r["s"]) // r["n"]
    return moved if moved.size and max(map(abs, moved.flat)) >= plain(dim) else moved.astype(np.int64)


def clusters(vectors: DataFrame, vec_id="vec_id", embedding="embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that counts, as a written table, and the final centroids.

    A vector counts if it has dim components, none of them null or not finite; others give no row. Components are
    floor(scale * x), and all that follows is exact: squared distances, sums, and means rounded down. The first centroids are
    the k vectors with the smallest SHA-256 of seed:id (a null id is empty text; equal ids go by components); fewer vectors
    make fewer centroids. Each round assigns every vector anew and keeps no state between rounds, so a lost executor costs
    its tasks only; centroids (k rows) go out with the tasks, sums of a task come back as k * dim rows and are added in Spark.
    Ties go to the smaller number. Repeated rows each count. An empty table gives no rows. Components up to about 10^27 have
    exact sums; a squared distance beyond 64 bits is returned as null.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"))
    centroids = _starts(rows, k, seed, dim, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(rows, centroids, dim, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = whole(batch.column(1), dim, scale)
            if not len(x):
                continue
            own, d, _ = nearest(x, centroids)
            far = [int(v) if v < 2**63 else None for v in d.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(counts)), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return materialize(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_report(vectors: DataFrame, vec_id="vec_id", embedding="embedding", **more) -> DataFrame:
    """clusters() with the sums of distances over each cluster and over all, and a digest of the cluster's final centroid.

    Both sums are longs (null beyond 64 bits). Sums are taken in Spark; what comes back and is broadcast has a row a centroid.
    """
    found, centroids = clusters(vectors, vec_id, embedding, **more)
    beyond = F.lit(str(2**63)).cast("decimal(38,0)")  # stands for a distance that is null
    sums = found.groupBy("cluster").agg(F.sum(F.coalesce(F.col("distance").cast("decimal(38,0)"), beyond)).alias("s")).collect()
    per = {r["cluster"]: int(r["s"]) for r in sums}
    fits = lambda s: s if s < 2**63 else None
    rows = [(c, fits(s), fits(sum(per.values())), centroid_digest(centroids[c])) for c, s in per.items()]
    wide = vectors.sparkSession.createDataFrame(rows, "at int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(wide), F.col("cluster") == F.col("at")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
