"""Clustering around centroids in integers, with a distance matrix that is kept and changed instead of computed anew.

Every vector keeps its exact dot products with all centroids. When centroids move, only
the components that changed are multiplied, and the products are added to what is kept;
distances follow from the products and the norms, and the nearest centroid from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vidlake.llm.storage import drop, save

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = "1"
#: Components up to which no product of two vectors of 64, nor a distance, leaves 64 bits.
GREATEST = 1 << 27

_KEPT = "vec_id long, q array<int>, dots array<long>, cluster int, distance long"


def quantized(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x) of every component of the vectors that have dims components, all finite."""
    e = F.col("embedding").cast("array<double>")
    whole = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale)).alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The k rows of smallest sha256 of `seed:vec_id`, in that order; rows of one vec_id in order of their components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    least = rows.select(F.sha2(name, 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in least], np.int64)


def _changes(old: np.ndarray, new: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each centroid: the components that differ, and by how much."""
    moved = new - old
    return [(at := np.flatnonzero(row), row[at]) for row in moved]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _update(changes: list, norms: np.ndarray):
    """A task's function: adds the changes to the kept products, and takes the nearest centroid by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(norms)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            dots = batch.column("dots").flatten().to_numpy(zero_copy_only=False).reshape(n, k) if "dots" in batch.schema.names else np.zeros((n, k), np.int64)
            dots = dots.copy()
            for c, (at, by) in enumerate(changes):
                if len(at):
                    dots[:, c] += q[:, at] @ by
            far = (q * q).sum(axis=1)[:, None] - 2 * dots + norms
            near = far.argmin(axis=1)  # the first of those that tie
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _lists(q, pa.int32()), _lists(dots, pa.int64()), pa.array(near, pa.int32()), pa.array(far[np.arange(n), near], pa.int64())],
                names=["vec_id", "q", "dots", "cluster", "distance"],
            )

    return run


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a cluster and task: how many vectors, their distances and each of their components added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        q = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
        cluster, distance = batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
        for c in np.unique(cluster):
            own = cluster == c
            sums[c] = sums.get(c, 0) + np.concatenate([[own.sum(), distance[own].sum()], q[own].sum(axis=0)])
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), _lists(np.array(list(sums.values())), pa.int64())], names=["cluster", "sums"])


def _totals(kept: DataFrame) -> dict[int, tuple[int, int, np.ndarray]]:
    """Of each non-empty cluster: count, inertia and sums of components; a number a cluster and component comes to the driver."""
    parts = kept.select("q", "cluster", "distance").mapInArrow(_partial, "cluster int, sums array<long>")
    rows = parts.select("cluster", F.posexplode("sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x")).collect()
    found: dict[int, list[int]] = {r.cluster: [0] * (DIMS + 2) for r in rows}
    for r in rows:
        found[r.cluster][r.pos] = r.x
    return {c: (x[0], x[1], np.array(x[2:], np.int64)) for c, x in found.items()}


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray, dict]:
    """(rows (vec_id, cluster, distance), centroids, (count, inertia, sums) of each non-empty cluster).

    Vectors without exactly DIMS components, or with a null or non-finite one, are left
    out. Centroids start as first_centroids; each round takes every vector to the
    nearest (the smaller number where they tie) and every centroid that has vectors to
    the floor of their mean; then vectors are assigned once more. With fewer vectors
    than k there are as many centroids as vectors; an empty table gives no rows. Rows
    that repeat a vec_id, or have none, are vectors of their own. Components of over
    2^27 after scaling are refused, as distances would not fit 64 bits. Columns other
    than vec_id and embedding are not looked at. The driver holds the centroids only.
    """
    rows = quantized(vectors)
    greatest = rows.agg(F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()[0]
    if greatest is not None and greatest > GREATEST:
        raise ValueError(f"a component of {greatest} after scaling: distances would not fit 64 bits")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, {}
    was, kept = np.zeros_like(centroids), rows.select("vec_id", F.col("q").cast("array<int>").alias("q"))
    for n in range(rounds + 1):
        norms = (centroids * centroids).sum(axis=1)
        step = save(kept.mapInArrow(_update(_changes(was, centroids), norms), _KEPT), "products", codec="zstd")
        drop(kept)
        kept, totals, was = step, _totals(step), centroids
        if n < rounds:
            centroids = centroids.copy()
            for c, (count, _, total) in totals.items():
                centroids[c] = total // count
    return kept.select("vec_id", "cluster", "distance"), centroids, totals


def clusters_with_digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that cluster_vectors keeps."""
    rows, centroids, totals = cluster_vectors(vectors)
    own = lambda values: F.get(F.array(*values), F.col("cluster")) if values else F.lit(None)
    inertia = [F.lit(totals.get(c, (0, 0))[1]).cast("long") for c in range(len(centroids))]
    digest = [F.sha2(F.lit(",".join(map(str, c.tolist()))), 256) for c in centroids]
    return rows.select(
        "vec_id", "cluster", "distance", own(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(t[1] for t in totals.values())).cast("long").alias("inertia"), own(digest).cast("string").alias("centroid_sha256"),
    )
