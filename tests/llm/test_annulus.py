"""Clusters beside plain rounds over all centroids: ties, repeats, nulls, odd lengths, large components, few and no vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import annulus

ROWS = "vec_id long, embedding array<double>"


def plain(rows, k=8, rounds=10):
    """(vec_id, cluster, distance) by full comparison in Python integers, and the centroids."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    own = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(own(v)[1], []).append(v)
        for n, g in groups.items():
            centroids[n] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    return [(i, own(v)[1], own(v)[0]) for i, v in kept], centroids


def report(rows):
    found, centroids = plain(rows)
    per = [sum(d for _, c, d in found if c == n) for n in range(8)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((tuple(r) + (per[r[1]], sum(per), digest[r[1]]) for r in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).round(2).tolist()) for i in range(60)]
    rows += [rows[5]] * 40 + [(None, rows[7][1]), (None, rows[7][1]), (70, [0.0] * 64), (71, None), (72, []), (73, [1.0] * 63), (74, [1.0] * 65), (75, [None] + [1.0] * 63)]
    rows += [(76, [math.nan] + [1.0] * 63), (77, [math.inf] + [1.0] * 63), (78, [-3.0e6] + [0.5] * 63), (79, [-0.0] * 64), (80, [-1e-9] * 64)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("cluster", "id", "v", "distance", "c", "at")})
    assert got(annulus.cluster_report(df)) == report(rows)


def test_ties_go_to_the_smaller_number():
    """Centroids on the border of the annulus, equal centroids, and points halfway between two."""
    centroids = np.array([[4, 0], [0, 4], [-4, 0], [4, 0], [0, 0], [2, 2]])
    x = np.array([[a, b] for a in range(-6, 7) for b in range(-6, 7)])
    every = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    number, d, compared = annulus.nearest(x, centroids)
    assert (number == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all() and compared < every.size


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert got(annulus.cluster_report(spark.createDataFrame(rows, ROWS))) == report(rows)


def test_components_beyond_64_bits(spark):
    rows = [(i, [1e9 * (i - 5)] + [float(i)] * 63) for i in range(12)]
    found = {r["vec_id"]: (r["cluster"], r["distance"]) for r in annulus.cluster_report(spark.createDataFrame(rows, ROWS)).collect()}
    told, _ = plain(rows)
    assert found == {i: (c, d if d < 2**63 else None) for i, c, d in told}
