"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

MIN_COSINE = 0.93
#: The codebook is fitted on at most so many vectors (those with the smallest hash of their values), in so many rounds.
SAMPLE, ROUNDS = 20_000, 10
#: A label and length of n vectors, as the sample tells, has sqrt(n) / ROOTS cells, two at least, and one for LEAST of the sample at most.
ROOTS, LEAST = 16, 5
#: Rows on each side of one block product.
BLOCK = 2048


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids (k or fewer rows) of unit vectors; ties go to the first centroid, an empty cell keeps its centroid."""
    centroids = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        for c in range(len(centroids)):
            total = sample[own == c].sum(axis=0)
            if (norm := np.linalg.norm(total)) > 0:
                centroids[c] = total / norm
    return centroids


def usable(vector: Column) -> Column:
    """True for vectors that have a direction: not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _block_links(group: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Links of one block: visitors (side 0) against residents (side 1).

    Of a visitor: how many rows it links with; of every linked row: the smallest id of its component within the block.
    """
    none = pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
    x, y = group[group["side"] == 0], group[group["side"] == 1]
    if x.empty or y.empty:
        return none
    near = units(x["v"]) @ units(y["v"]).T >= min_cosine
    xi, yi = x["id"].to_numpy(), y["id"].to_numpy()
    near &= xi[:, None] != yi[None, :]
    n = near.astype(np.int64) @ y["rows"].to_numpy()
    a, b = near.any(axis=1), near.any(axis=0)
    if not a.any():
        return none
    near, xi, yi, n = near[a][:, b], xi[a], yi[b], n[a]
    root_x, root_y, top = xi.copy(), yi.copy(), np.iinfo(np.int64).max
    while True:
        new_x = np.minimum(root_x, np.where(near, root_y[None, :], top).min(axis=1))
        new_y = np.minimum(root_y, np.where(near, new_x[:, None], top).min(axis=0))
        if (new_x == root_x).all() and (new_y == root_y).all():
            break
        root_x, root_y = new_x, new_y
    return pd.DataFrame({"id": np.concatenate([xi, yi]), "n": np.concatenate([n, np.zeros(len(yi), dtype=np.int64)]), "root": np.concatenate([root_x, root_y])})


def vector_groups(vectors: DataFrame, vec_id="vec_id", embedding="embedding", label="label", min_cosine: float = MIN_COSINE, cell_rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; vectors are compared only within one label that isn't null.

    Equal vectors of one label (and one number of components) are merged first, so a third of all rows may be one vector.
    A vector lives in the cell of its nearest centroid, in the ring of its angle to it. It visits every other cell whose
    vectors may be near enough: those on whose side of the halfway plane a vector could lie within the chord of the angle,
    and there the rings (as wide as the limit) next to its own angle; so no link is lost at a border, and each is
    counted where the other end lives. Cells with more than `block` rows are cut into blocks, product by product. The
    codebooks, one for each label and length, are fitted on a bounded sample; a label or length without a place in it is one
    cell. Everything else covers all rows, of any number of lengths. Vectors that no cells part (all about as far from each
    other) are compared pair by pair.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those of a null
    label or of another length. A null vec_id is no one's component_id unless it stands alone (then null, kept). Repeated
    rows are links of each other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    key = F.struct(F.xxhash64(F.lit(1), v).alias("p"), F.xxhash64(F.lit(2), v).alias("q"), F.size(v).alias("dim"))
    all_rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    ok = usable(v) & F.col("label").isNotNull()
    all_rows = all_rows.select("vec_id", "label", F.when(ok, v).alias("v"), F.when(ok, key).alias("key"))
    merged = all_rows.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("vec_id").alias("first"), F.count("*").alias("rows"), F.first("v").alias("v"))
    merged = materialize(merged.withColumn("id", F.monotonically_increasing_id()))  # ids are fixed by being written

    links = materialize(_links_of(merged, min_cosine, cell_rows, block))
    degree = links.groupBy("id").agg(F.sum("n").alias("n"))
    groups = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    classed = materialize(merged.select("id", "label", "key", "first", "rows").join(degree, "id", "left").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")))
    smallest = classed.groupBy("component").agg(F.min("first").alias("component_id"))
    per = classed.join(smallest, "component").select(F.col("label").alias("l"), F.col("key").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n"), F.col("component_id").alias("c"))
    joined = all_rows.drop("v").join(per, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def codebooks(sample: pd.DataFrame, n: int, cell_rows: int | None = None) -> dict[tuple, np.ndarray]:
    """Centroids by (label, length) from a sample (label, v) of n rows: two at least, as many as the root of a group's rows tells
    (ROOTS), or one for so many rows if cell_rows is given.

    Each group has no more than one for LEAST of its sampled rows, so the sample bounds all; a group with a single sampled
    vector is one cell.
    """
    books = {}
    for (label, dim), rows in sample.groupby([sample["label"], sample["v"].map(len)], sort=True):
        told = len(rows) / len(sample) * n
        k = min(math.ceil(told / cell_rows), len(rows)) if cell_rows else min(round(math.sqrt(told) / ROOTS), len(rows) // LEAST)
        if len(rows) > 1:
            books[label, dim] = spherical_kmeans(units(rows["v"]), max(2, k))
    return books


def place(labels: pd.Series, vectors: pd.Series, books: dict[tuple, np.ndarray], min_cosine: float) -> pd.DataFrame:
    """home and visits of each vector: its own (cell, ring), and all in which a vector near enough may live; of one label and length."""
    ring = math.acos(min_cosine) + 1e-6  # as wide as the limit: what is near enough lies in the same ring or the next on either side
    chord = math.sqrt(2 - 2 * min_cosine) + 1e-9
    homes, visits = [(0, 0)] * len(vectors), [[(0, 0)]] * len(vectors)
    keys = pd.DataFrame({"label": labels.to_numpy(), "dim": vectors.map(len).to_numpy()})
    for key, at in keys.groupby(["label", "dim"]).indices.items():
        centroids = books.get(key)
        if centroids is None:
            continue
        s = np.clip(units(vectors.iloc[at]) @ centroids.T, -1, 1)
        own, rings = np.argmax(s, axis=1), (np.arccos(s) / ring).astype(np.int64)
        apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-18))
        # distance to the plane halfway between the home centroid and another, on whose far side the other's vectors lie
        beyond = (s[np.arange(len(s)), own][:, None] - s) / apart[own]
        near = (beyond <= chord) | (np.arange(len(centroids)) == own[:, None])
        for i, row in enumerate(at):
            homes[row] = (own[i], rings[i, own[i]])
            visits[row] = [(c, r) for c in np.flatnonzero(near[i]) for r in range(max(0, rings[i, c] - 1), rings[i, c] + 2)]
    of = lambda found: [{"cell": int(c), "ring": int(r)} for c, r in found]
    return pd.DataFrame({"home": of(homes), "visits": [of(v) for v in visits]})


def _links_of(merged: DataFrame, min_cosine: float, cell_rows: int | None, block: int) -> DataFrame:
    """(id, n, root) rows of all links among the merged vectors."""
    rows = merged.count()
    sample = merged.orderBy("key").limit(SAMPLE).select(F.col("label").cast("string").alias("label"), "v").toPandas()
    books = codebooks(sample, rows, cell_rows) if rows else {}

    @F.pandas_udf("home struct<cell:int,ring:int>, visits array<struct<cell:int,ring:int>>")
    def cells(labels: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        return place(labels, vectors, books, min_cosine)

    part_of = ["label", "dim", "cell", "ring"]
    narrow = ["id", "label", F.col("key.dim").alias("dim"), "rows", "v"]
    placed = materialize(merged.select(*narrow, cells(F.col("label").cast("string"), "v").alias("c")).select("id", "label", "dim", "rows", "v", "c.home", "c.visits"))
    homes = placed.select("id", "label", "dim", "rows", "v", "home.cell", "home.ring")
    guests = placed.select("id", "label", "dim", "rows", "v", F.explode("visits").alias("at")).select("id", "label", "dim", "rows", "v", "at.cell", "at.ring")
    live = homes.groupBy(*part_of).agg(F.count("*").alias("live"))
    come = guests.groupBy(*part_of).agg(F.count("*").alias("come"))
    # a ring in which no vector lives has no block: visits there end in this join
    blocks = live.join(come, part_of).select(*part_of, F.ceil(F.col("live") / block).cast("int").alias("ny"), F.ceil(F.col("come") / block).cast("int").alias("nx"))
    blocks = materialize(blocks)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = homes.join(blocks, part_of).select("id", "rows", "v", *part_of, part("ny").alias("y"), every("nx").alias("x"), F.lit(1).alias("side"))
    guests = guests.join(blocks, part_of).select("id", "rows", "v", *part_of, every("ny").alias("y"), part("nx").alias("x"), F.lit(0).alias("side"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _block_links(group, min_cosine)

    return homes.unionByName(guests).groupBy(*part_of, "y", "x").applyInPandas(run, "id long, n long, root long")
