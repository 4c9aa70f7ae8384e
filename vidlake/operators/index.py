"""Search and matching of many vectors: an inverted file that is probed, and exact matching by pivots.

Centroids and pivots come from a sample of bounded size; every vector is then placed by
them. Lists and cells are cut into parts of bounded size, so none is one task's work
however many vectors it holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vidlake.operators.embed import TILE_CELLS, search_topk, unit_rows
from vidlake.operators.storage import deleted, scratch_dir, written

#: Vectors that centroids and pivots are chosen from, and how many of either there are at most.
SAMPLE, MOST = 20_000, 4096
#: Rows of a list or cell that one task handles at once.
PART_ROWS = 20_000
#: Probes that are sent through the lists at once.
PROBE_BLOCK = 50_000


def _named(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _sample(vectors: DataFrame, total: int, size: int) -> np.ndarray:
    """About `size` of the vectors, at most half as many again, chosen by a hash of their id, as unit rows."""
    share = min(1.0, size / max(total, 1))
    kept = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("vec_id"), "vec_id").limit(size + size // 2)
    rows = kept.toArrow().column("embedding").combine_chunks()
    return unit_rows(rows) if len(rows) else np.zeros((0, 0))


def _centroids(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit vectors around which the sample gathers."""
    centres = rows[np.random.default_rng(7).permutation(len(rows))[:k]]
    for _ in range(rounds):
        near = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _to_lists(shared, probes: int):
    """A task's function: every vector with the `probes` nearest centroids' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = np.argsort(-(unit_rows(batch.column("embedding")) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(batch)), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column("vec_id").take(pa.array(row)), batch.column("embedding").take(pa.array(row))], names=["list", "vec_id", "embedding"])

    return run


_PLACED = "list int, vec_id long, embedding array<double>"


def _part(count: dict[int, int], lists: int, rows: int) -> list[int]:
    return [max(1, -(-count.get(k, 0) // rows)) for k in range(lists)]


@dataclass
class VectorIndex:
    """postings (list, part, vec_id, embedding): every vector of the gallery, in a table bucketed by list and part."""

    centroids: np.ndarray
    parts: list[int]
    postings: DataFrame
    probes: int


def build_index(gallery: DataFrame, lists: int | None = None, recall: float = 0.95, k: int = 10, queries: int = 200, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> VectorIndex:
    """An inverted file over every row of gallery (vec_id, embedding).

    Centroids (the root of the number of vectors, 4,096 at most) come from `sample` rows.
    How many lists a search probes is the least number that finds `recall` of the exact
    k nearest of `queries` sampled rows, whose exact neighbours are searched among all rows.
    """
    spark = gallery.sparkSession
    rows = _named(gallery)
    total = rows.count()
    lists = lists or min(MOST, max(1, int(total**0.5)))
    chosen = _sample(rows, total, sample)
    if not len(chosen):
        raise ValueError("an index needs vectors")
    centres = _centroids(chosen, min(lists, len(chosen)))
    shared = spark.sparkContext.broadcast(centres)
    placed = written(rows.mapInArrow(_to_lists(shared, 1), _PLACED), "placed")
    parts = _part({r.list: r["count"] for r in placed.groupBy("list").count().collect()}, len(centres), part_rows)
    cut = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.get(F.lit(parts), F.col("list"))).cast("int"))
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"postings_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    cut.repartition(n, "list", "part").write.bucketBy(n, "list", "part").sortBy("list", "part").option("path", path).saveAsTable(name)
    asked = rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(queries)
    exact = search_topk(asked, rows, k).select("probe_id", "vec_id")
    where = placed.join(F.broadcast(exact), "vec_id").select("probe_id", "list").collect()  # k rows a query
    near = {r.vec_id: np.argsort(-(unit_rows(pa.array([r.embedding])) @ centres.T)[0], kind="stable").tolist() for r in asked.collect()}
    ranks = sorted(near[r.probe_id].index(r.list) for r in where)
    probes = 1 + ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] if ranks else 1
    deleted(placed)
    return VectorIndex(centres, parts, spark.table(name), probes)


def _best_of(k: int):
    """A function of a part of a list and the probes that look into it: the k best of the part for each, and those that tie with the last."""

    def run(postings: pa.Table, probes: pa.Table) -> pa.Table:
        found = []
        if postings.num_rows and probes.num_rows:
            ids, names = postings.column("vec_id").to_numpy(), probes.column("probe_id").to_numpy()
            v, p = unit_rows(postings.column("embedding").combine_chunks()), unit_rows(probes.column("embedding").combine_chunks())
            step = max(1, TILE_CELLS // len(ids))
            for at in range(0, len(names), step):
                near = (p[at : at + step] @ v.T).round(6)
                cut = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(near), -np.inf)
                q, j = np.nonzero(near >= cut[:, None])
                found.append((names[at + q], ids[j], near[q, j]))
        columns = [np.concatenate([f[c] for f in found]) if found else [] for c in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["probe_id", "vec_id", "cosine"])

    return run


def search_index(index: VectorIndex, probes: DataFrame, k: int, lists: int | None = None) -> DataFrame:
    """(probe_id, vec_id, cosine, rank) of the k nearest that the probed lists hold; search_topk is the exact way.

    lists: how many lists a probe looks into, else what build_index found. Probes go
    in blocks of PROBE_BLOCK, so a list that draws all of them gets no more at once.
    """
    spark = probes.sparkSession
    shared = spark.sparkContext.broadcast(index.centroids)
    blocks = max(1, -(-probes.count() // PROBE_BLOCK))
    sent = _named(probes).mapInArrow(_to_lists(shared, min(lists or index.probes, len(index.centroids))), _PLACED)
    last = F.get(F.lit(index.parts), F.col("list")) - 1
    sent = sent.select("list", F.explode(F.sequence(F.lit(0), last)).alias("part"), F.col("vec_id").alias("probe_id"), "embedding").withColumn("block", F.pmod(F.xxhash64("probe_id"), F.lit(blocks)))
    out = None
    for n in range(blocks):
        own = index.postings.groupBy("list", "part").cogroup(sent.where(F.col("block") == n).groupBy("list", "part")).applyInArrow(_best_of(k), "probe_id long, vec_id long, cosine double")
        out = own if out is None else out.unionByName(own)
    order = Window.partitionBy("probe_id").orderBy(F.desc("cosine"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_CELLS = "cell int, far double, vec_id long, v array<double>"
#: Room for rounding of distances in the triangle bounds.
SLACK = 1e-6


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (unit @ pivots.T)))


#: Distances to pivots, and vectors of cells, that a task holds at once: 16 MB of the one, 4 MB of the other at 64 components.
CELL_TILE, CELL_ROWS = 2_000_000, 8192


def _to_cells(shared, reach: float | None):
    """A task's function: each vector in the cell of its nearest pivot; or, with a reach, in every cell that could hold a match of it.

    A match x of y lies within reach r. Where x's nearest pivot is p and o is another, x.p >= x.o,
    so y.o - y.p <= r |o - p|; here o is y's own nearest pivot. And d(y,p) differs from x's by at most r.
    A vector is sent to as many cells as pivots are that near, so a batch goes in tiles of
    CELL_TILE distances and leaves in batches of CELL_ROWS rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, low, high = shared.value
        step = max(1, CELL_TILE // max(1, len(pivots)))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                unit = unit_rows(part.column("embedding"))
                cosine = unit @ pivots.T
                far = np.sqrt(np.maximum(0.0, 2 - 2 * cosine))
                if reach is None:
                    row, cell = np.arange(len(part)), far.argmin(1)
                else:
                    own = cosine.argmax(1)
                    near = cosine[np.arange(len(part)), own][:, None] - cosine <= reach * _distances(pivots[own], pivots) + SLACK
                    near &= (far >= low - reach - SLACK) & (far <= high + reach + SLACK)
                    row, cell = np.nonzero(near)
                far, ids = far[row, cell], part.column("vec_id")
                for lo in range(0, len(row), CELL_ROWS):
                    own = unit[row[lo : lo + CELL_ROWS]]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * unit.shape[1]), pa.array(own.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[lo : lo + CELL_ROWS], pa.int32()), pa.array(far[lo : lo + CELL_ROWS]), ids.take(pa.array(row[lo : lo + CELL_ROWS])), lists], names=["cell", "far", "vec_id", "v"])

    return run


def _within(least: float, reach: float, compared):
    """A function of two parts of a cell: their pairs of at least that cosine. Only rows whose distances to the pivot differ by at most reach are multiplied."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            a, b = a.sort_by("far"), b.sort_by("far")
            x, y = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (a, b))
            fa, fb, ia, ib = a.column("far").to_numpy(), b.column("far").to_numpy(), a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            for at in range(0, len(fa), 64):
                lo = np.searchsorted(fb, fa[at] - reach - SLACK)
                hi = np.searchsorted(fb, fa[min(at + 64, len(fa)) - 1] + reach + SLACK, "right")
                own, near = x[at : at + 64], y[lo:hi]
                if compared is not None:
                    compared.add(len(own) * len(near))
                cosine = own @ near.T
                i, j = np.nonzero(cosine >= least)
                keep = ia[at + i] < ib[lo + j]
                found.append((ia[at + i][keep], ib[lo + j][keep], cosine[i, j][keep].round(6)))
        columns = [np.concatenate([f[c] for f in found]) if found else [] for c in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["id_a", "id_b", "cosine"])

    return run


def match_within(a: DataFrame, b: DataFrame, max_l2: float, pivots: int | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS, compared=None) -> DataFrame:
    """(id_a, id_b, cosine) of all pairs, id_a < id_b, whose unit vectors lie within max_l2: exact, and without keys.

    Each of a lies in the cell of its nearest pivot; each of b is sent to every cell
    whose border it is near enough to. Cells are cut into parts on both sides, each of
    which meets each. How much is compared hangs on how max_l2 compares with the spread
    of the vectors; compared: an accumulator that counts it.
    """
    spark = a.sparkSession
    x, y = _named(a), _named(b)
    total = x.count()
    chosen = _sample(x, total, min(sample, pivots or min(MOST, max(1, int(4 * total**0.5)))))
    if not len(chosen):
        return spark.createDataFrame([], "id_a long, id_b long, cosine double")
    shared = spark.sparkContext.broadcast((chosen, None, None))
    left = written(x.mapInArrow(_to_cells(shared, None), _CELLS), "cells")
    stats = {r.cell: r for r in left.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    ends = lambda name, none: np.array([stats[k][name] if k in stats else none for k in range(len(chosen))])
    bounded = spark.sparkContext.broadcast((chosen, ends("low", np.inf), ends("high", -np.inf)))  # an empty cell draws nothing
    right = written(y.mapInArrow(_to_cells(bounded, max_l2), _CELLS), "borders")
    n_left = _part({k: r.n for k, r in stats.items()}, len(chosen), part_rows)
    n_right = _part({r.cell: r["count"] for r in right.groupBy("cell").count().collect()}, len(chosen), part_rows)
    own = lambda parts: F.pmod(F.xxhash64("vec_id"), F.get(F.lit(parts), F.col("cell"))).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.get(F.lit(parts), F.col("cell")) - 1))
    left = left.withColumn("i", own(n_left)).withColumn("j", every(n_right))
    right = right.withColumn("j", own(n_right)).withColumn("i", every(n_left))
    keys = ["cell", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_within(1 - max_l2 * max_l2 / 2, max_l2, compared), "id_a long, id_b long, cosine double")
