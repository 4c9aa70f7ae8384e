"""N-gram Jaccard join: documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

The document by n-gram incidence matrix is multiplied by its transpose in blocks of
columns (buckets of n-gram hashes). Size-derived bounds thin the matrix: a set of n
shingles keeps only the n - ceil(0.8 n) + 1 columns that a global order puts first
(rarest first, by a fixed-size sketch of all n-gram counts), since sets that share none
of these cannot reach 0.8; pairs whose sizes differ by more than a fifth are dropped
unseen. What the thinned product proposes is then counted exactly: overlaps are added up
over BLOCKS blocks of columns, and a pair is discarded as soon as its count and the
columns still to come cannot reach the bound of its sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vidlake.llm import setjoin
from vidlake.llm.storage import drop, free_name, save, save_bucketed
from vidlake.llm.textscan import scan, set_hash, shingles

WORDS = 5
#: The sketch has 2 ** SKETCH_BITS counters whatever the input's size: 2 MB when broadcast.
SKETCH_BITS = 21
CHUNK = 4096
#: Blocks of columns, by the highest bits of the n-gram hashes, over which overlaps are added up.
BLOCK_BITS = 2
BLOCKS = 1 << BLOCK_BITS
SALTS = 16


def distinct_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingle hashes, ascending) for each row of a text column."""
    for lo, found in scan(column):
        for k in range(len(found.first) - 1):
            yield lo + k, np.unique(shingles(found.hashes[found.first[k] : found.first[k + 1]], words))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size and identity of every document, and at the end this task's n-gram counts."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    waiting, size = [], 0
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        n, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for k, own in distinct_sets(batch.column("text")):
            n[k], ids[k] = len(own), set_hash(own)
            waiting.append(_bucket(own))
            size += len(own)
            if size > 1 << 21:
                counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                waiting, size = [], 0
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(ids), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=schema)
    if waiting:
        counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
    used = [k for k in range(len(counts) // CHUNK) if counts[k * CHUNK : (k + 1) * CHUNK].any()]
    blobs = [zlib.compress(counts[k * CHUNK : (k + 1) * CHUNK].astype("<u4").tobytes(), 1) for k in used]
    rows = len(used)
    yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64())] * 3 + [pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of each chunk summed over the tasks, as one byte of three steps a doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
            total[chunk] = total[chunk] + one if chunk in total else one
    steps = [np.minimum(127, np.round(3 * np.log2(v + 1.0))).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(steps, pa.binary())], names=["chunk", "steps"])


def _places(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places of a set's elements in the global order (the counters' steps, then the hashes), ascending."""
    return np.sort((level[_bucket(own)].astype(np.int64) << 55) | (own >> np.uint64(9)).astype(np.int64))


def prefix_size(n: int, num: int = setjoin.NUM, den: int = setjoin.DEN) -> int:
    return n - -(-n * num // den) + 1


def _incidence(levels):
    """A task's function: the columns (h, id, r) that the size bound keeps of each document; r: place in the set, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen: set[int] = set()
        for batch in batches:
            known = batch.column("doc_id").is_valid()
            hs, ids, places, size = [], [], [], 0
            pack = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places).astype(np.int32))], names=["h", "id", "r"])
            for k, own in distinct_sets(batch.column("text")):
                if not len(own) or not known[k].as_py() or (me := int(set_hash(own))) in seen:
                    continue
                seen.add(me)  # a copy within the task adds no column
                keep = own[np.argsort(level[_bucket(own)], kind="stable")[: prefix_size(len(own))]]
                hs.append(keep)
                ids.append(np.full(len(keep), me))
                places.append(np.arange(1, len(keep) + 1))
                size += len(keep)
                if size > 1 << 18:
                    yield pack()
                    hs, ids, places, size = [], [], [], 0
            if hs:
                yield pack()

    return run


_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("after", pa.list_(pa.int32())), *((f"p{k}", pa.list_(pa.int64())) for k in range(BLOCKS))])


def _kind(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'array<' + str(f.type.value_type).replace('int64', 'long').replace('int32', 'int') + '>' if pa.types.is_list(f.type) else 'long'}" for f in schema)


def _whole_sets(levels):
    """A task's function: the sets of the wanted documents by block of columns, and where their prefixes end in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_SETS), _SETS)], schema=_SETS)
        edges = np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(64 - BLOCK_BITS)
        before = None
        for batch in batches:
            wanted = batch.column("id").to_numpy()
            rows, size = [], 0
            for k, own in distinct_sets(batch.column("text")):
                # rows that repeat a doc_id come one after another from the merge join
                if len(own) and wanted[k] != before and set_hash(own) == wanted[k]:
                    before = wanted[k]
                    parts = np.split(own.view(np.int64), np.searchsorted(own, edges))
                    after = len(own) - np.cumsum([len(p) for p in parts])
                    rows.append((wanted[k], len(own), int(_places(own, level)[prefix_size(len(own)) - 1]), after, *parts))
                    size += len(own)
                if size > 1 << 19:
                    yield flush(rows)
                    rows, size = [], 0
            yield flush(rows)

    return run


def ngram_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs (doc_id, text, ...).

    Null, empty or blank text: no shingles, component_id is the doc_id. A row without
    a doc_id is linked with nothing and has no component_id. Rows that repeat a doc_id
    stay; each is compared by its own text. Other columns are not looked at. An empty
    table gives no rows. Sets are identified by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = save(docs.mapInArrow(_describe, "doc_id long, n long, id long, chunk int, counts binary"), "sets")
    table = described.where("chunk is null").select("doc_id", "n", "id")
    parts = described.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_add_up, "chunk int, steps binary").collect()
    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    for chunk, steps in parts:
        level[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(steps, np.uint8)
    levels = spark.sparkContext.broadcast(level)
    incidence = save_bucketed(docs.mapInArrow(_incidence(levels), "h long, id long, r int"), "incidence", "h")
    column = Window.partitionBy("h")
    members = incidence.withColumn("lo", F.min("id").over(column)).withColumn("hi", F.max("id").over(column))
    members = save(members.where("lo <> hi").select("h", "id", "r").distinct(), "columns")
    drop(incidence)
    firsts = table.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    firsts = save(firsts, "firsts")
    wanted = save(members.select("id").distinct().join(firsts.hint("merge"), "id").select("doc_id", "id"), "wanted")
    sets = save(docs.join(wanted.hint("merge"), "doc_id").select("id", "text").mapInArrow(_whole_sets(levels), _kind(_SETS)), "whole")
    labels = setjoin.link_components(members, sets, prefixes=True, blocks=BLOCKS)
    for t in (sets, members, wanted):
        drop(t)
    grouped = save(firsts.join(labels.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")), "grouped")
    for t in (firsts, labels):
        drop(t)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    of_set = grouped.join(least.hint("merge"), "component").select("id", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = table.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = rows.join(of_set.hint("merge"), ["id", "salt"], "left")
    linked = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs less all but the document with the smallest doc_id of each component; columns of any names pass through.

    Of rows that repeat a doc_id within a component, all stay with that doc_id if it is
    the smallest: they are one document. Rows without a doc_id stay.
    """
    own = free_name(docs, "gone")
    gone = ngram_join(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(save(gone, "gone").hint("merge"), F.col("doc_id") == F.col(own), "left_anti")
