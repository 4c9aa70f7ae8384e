"""Line dedup over levelled sorted runs of line hashes.

The index holds, per line key, how many documents had it. Each batch of documents
merge-anti-joins the keys that are already settled (found in enough documents), and
adds the counts of the others as a sorted run of its own. When a level has FANOUT runs
they are compacted into one run of the next level, and keys that have come to enough
documents move to the settled runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vidlake.llm.storage import drop, free_name, save, save_bucketed, shuffle_partitions

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
SALTS = 16
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased; empty for a blank line."""
    return line.strip(_SPACE).lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct line hashes."""
    for batch in batches:
        docs, parts, keys = [], [], []
        for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()):
            own = {k for line in (text or b"").split(b"\n") if (k := line_key(line))}
            docs += [doc] * len(own)
            parts += [part] * len(own)
            keys += map(_hash, own)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.int32())], names=["doc_id", "key", "batch"])


class LineIndex:
    """Levelled runs (key, docs) and settled runs (key), all sorted by key.

    It takes any number of batches, and can be stored and opened again for later ones.
    Only settled keys, which are in enough documents already, need no more counting, so
    it is these runs that a batch anti-joins; the other runs are met when runs are
    compacted.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _all(self, runs: list[DataFrame], kind: str) -> DataFrame:
        out = self.spark.createDataFrame([], kind)
        for r in runs:
            out = out.unionByName(r)
        return out

    def _compact(self, runs: list[DataFrame]) -> DataFrame:
        total = save(self._all(runs, "key binary, docs long").groupBy("key").agg(F.sum("docs").alias("docs")), "merged")
        self.settled.append(save_bucketed(total.where(F.col("docs") >= self.min_docs).select("key"), "settled", "key"))
        rest = save_bucketed(total.where(F.col("docs") < self.min_docs), "run", "key")
        for r in [*runs, total]:
            drop(r)
        return rest

    def add(self, keys: DataFrame) -> None:
        """keys: one row (key) for each document of a new batch and each key that it has."""
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
        for run in self.settled:
            counts = counts.join(run.hint("merge"), "key", "left_anti")
        self.levels[0].append(save_bucketed(counts, "run", "key"))
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._compact(self.levels[k]))
            self.levels[k] = []

    def store(self, path: str) -> None:
        """Write the runs to a folder that open() reads."""
        rows = self._all([], "key binary, docs long, level int, run int")
        for k, level in enumerate([self.settled, *self.levels]):
            for j, r in enumerate(level):
                docs = F.col("docs") if k else F.lit(self.min_docs).cast("long")
                rows = rows.unionByName(r.select("key", docs.alias("docs"), F.lit(k - 1).alias("level"), F.lit(j).alias("run")))
        rows.repartition("level", "run", F.xxhash64("key") % shuffle_partitions(self.spark)).sortWithinPartitions("level", "run", "key").write.partitionBy("level", "run").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> LineIndex:
        """The index that store() wrote, with the min_docs it was made for; its folder is only read."""
        out = cls(spark, min_docs, fanout)
        rows = spark.read.schema("key binary, docs long, level int, run int").parquet(path)
        for level, run in sorted(map(tuple, rows.select("level", "run").distinct().collect())):  # a few runs a level
            own = rows.where((F.col("level") == level) & (F.col("run") == run))
            if level < 0:
                out.settled.append(own.select("key"))
            else:
                out.levels += [[] for _ in range(level + 1 - len(out.levels))]
                out.levels[level].append(own.select("key", "docs"))
        return out

    def close(self) -> None:
        """Delete the runs; what frequent() returned can't be read any more."""
        for r in [*self.settled, *(r for level in self.levels for r in level)]:
            drop(r)

    def frequent(self) -> DataFrame:
        """(key) of the keys in at least min_docs documents so far."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels[1:]] + [[self._compact(runs)]]
        elif runs and not self.settled:
            self.levels = [[self._compact(runs)]]
        return self._all(self.settled, "key binary")


def _without(at: int, drop_at: int):
    """Replaces column `at` (text), using column `drop_at` (hashes to drop), and adds the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped, digests = [], [], [], []
            for text, gone in zip(batch.column(at).cast(pa.large_binary()).to_pylist(), batch.column(drop_at).to_pylist()):
                rows = (text or b"").split(b"\n")
                gone = set(gone or ())
                stay = [r for r in rows if not ((k := line_key(r)) and _hash(k) in gone)] if gone else rows
                body = b"\n".join(stay)
                kept.append(body)
                lines.append(len(rows))
                dropped.append(len(rows) - len(stay))
                digests.append(hashlib.sha256(body).hexdigest())
            columns = [batch.column(k) for k in range(batch.num_columns) if k != drop_at]
            columns[at] = pa.array(kept, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())],
                names=[f"c{k}" for k in range(len(columns) + 3)],
            )

    return run


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, index: LineIndex | None = None) -> DataFrame:
    """docs with a text from which every line is gone whose key is in at least min_docs documents,
    and the columns n_lines, n_dropped, kept_sha256 (these names replace columns of docs).

    Every row is a document, also where a doc_id repeats or is null. A null or empty
    text is one empty line, which is never dropped; the text returned is then empty.
    Blank lines have no key and stay. Other columns pass through, whatever their names;
    an empty table gives no rows. Keys are compared by 128-bit hashes. batches: parts
    in which docs go to the index. index: one of earlier documents, whose counts these
    add to; it is kept.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    names = docs.columns
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    keys = docs.select(F.col("doc_id").cast("long"), batch, F.col("text").cast("string")).mapInArrow(_line_hashes, "doc_id long, key binary, batch int")
    keys = save(keys, "linekeys", by="batch")
    kept, index = index is not None, index or LineIndex(spark, min_docs)
    for k in range(batches):
        index.add(keys.where(F.col("batch") == k).select("key"))
    # written anew: read from the buckets, it would be joined by key alone and a hot key's salts would meet again
    frequent = save(index.frequent().select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "frequent")
    salted = keys.select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = salted.join(frequent.hint("merge"), ["key", "salt"]).groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    doc = free_name(docs, "doc")
    gone = save(gone.select(F.col("doc_id").alias(doc), F.col("gone").alias(free_name(docs, "gone"))), "gone")
    drop(frequent)
    drop(keys)
    if not kept:
        index.close()
    both = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left").drop(doc)
    text_at = names.index("text")
    fields = [T.StructField(f"c{k}", T.StringType() if k == text_at else docs.schema[k].dataType) for k in range(len(names))]
    fields += [T.StructField(f"c{len(names)}", T.LongType()), T.StructField(f"c{len(names) + 1}", T.LongType()), T.StructField(f"c{len(names) + 2}", T.StringType())]
    return both.mapInArrow(_without(text_at, len(names)), T.StructType(fields)).toDF(*names, "n_lines", "n_dropped", "kept_sha256")
