"""Benchmark decontamination: which documents hold a benchmark item, however long they are.

Items are partitioned by the size of their shingle set. For each partition a MinHash
sketch (the items' smallest hashes) is made just large enough that a document holding
THRESHOLD of an item must hold one of its sketch values: of n shingles, n - ceil(0.8 n) + 1
for the largest n of the partition. Documents keep all their hashes rather than a
sketch: a 20-word item and a 20,000-word document have a Jaccard similarity of a
thousandth, which no banding finds. Candidates are then verified by exact containment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vidlake.llm.storage import save
from vidlake.llm.textscan import grams, mix, scan, shingles

WORDS = 5
NUM, DEN = 80, 100
#: Shingles of the items that are broadcast at once (8 bytes each); more items are searched in further blocks.
BLOCK_SHINGLES = 1 << 20


def _describe_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("item_id", pa.int64()), ("words", pa.int32()), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        words, sets = [0] * batch.num_rows, [None] * batch.num_rows
        for lo, found in scan(batch.column("text")):
            for k in range(len(found.first) - 1):
                own = found.hashes[found.first[k] : found.first[k + 1]]
                words[lo + k] = min(WORDS, len(own))
                sets[lo + k] = np.unique(shingles(own, WORDS)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.int32()), pa.array(sets, kind.field(2).type)], schema=kind)


class ItemBlock:
    """Some items, their size-partitioned MinHash sketches, and the search of a document for them."""

    def __init__(self, rows: list):
        self.items = [r.item_id for r in rows]
        self.sets = [np.array(r.shingles, np.int64).view(np.uint64) for r in rows]
        self.lengths = sorted({r.words for r in rows})
        owners: dict[int, list[int]] = {}
        for k, own in enumerate(self.sets):
            largest = 2 ** int(len(own)).bit_length() - 1  # of this item's size partition
            sketch = own[np.argsort(mix(own))[: largest - -(-largest * NUM // DEN) + 1]]
            for h in sketch.tolist():
                owners.setdefault(h, []).append(k)
        self.owners = owners
        self.keys = np.array(sorted(owners), np.uint64)
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item's place, shingles shared) of the items of which the words hold enough."""
        all_of = [grams(words, m) for m in self.lengths]
        found = np.concatenate(all_of) if all_of else np.zeros(0, np.uint64)
        near = found[self.mask[(found >> np.uint64(44)).astype(np.int64)]]
        if not len(near):
            return []
        near = np.unique(near)
        near = near[np.isin(near, self.keys)]
        if not len(near):
            return []
        every, out = np.unique(found), []
        for k in sorted({k for h in near.tolist() for k in self.owners[h]}):
            at = np.minimum(np.searchsorted(every, self.sets[k]), len(every) - 1)
            shared = int((every[at] == self.sets[k]).sum())
            if shared * DEN >= len(self.sets[k]) * NUM:
                out.append((k, shared))
        return out


def _blocks(items: DataFrame) -> Iterator[ItemBlock]:
    """The items in blocks of bounded size; only one block is in the driver at a time."""
    table = save(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_describe_items, "item_id long, words int, shingles array<long>")
        .where("size(shingles) > 0")
        .dropDuplicates(["item_id", "words", "shingles"]),
        "items",
    )
    rows, size = [], 0
    for row in table.toLocalIterator():
        rows.append(row)
        size += len(row.shingles)
        if size >= BLOCK_SHINGLES:
            yield ItemBlock(rows)
            rows, size = [], 0
    if rows:
        yield ItemBlock(rows)


def _hits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            at, item, n, both = [], [], [], []
            for lo, found in scan(batch.column("text")):
                for k in range(len(found.first) - 1):
                    for i, s in block.search(found.hashes[found.first[k] : found.first[k + 1]]):
                        at.append(lo + k)
                        item.append(block.items[i])
                        n.append(len(block.sets[i]))
                        both.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(both, pa.int64())],
                names=["doc_id", "item_id", "n_shingles", "n_shared"],
            )

    return run


def find_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for every document and item of whose n_shingles
    distinct 5-word shingles at least 80 % are in the document.

    A-Z count as a-z. An item of fewer than five words is searched as one shingle of its
    own length; a null or blank item, and a null or blank document, matches nothing.
    Rows that repeat an item are one item; rows that repeat a doc_id are searched each.
    Null ids are carried. Other columns are not looked at; empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, item_id long, n_shingles long, n_shared long"
    out = spark.createDataFrame([], kinds)
    for block in _blocks(items):
        out = out.unionByName(texts.mapInArrow(_hits(spark.sparkContext.broadcast(block)), kinds))
    return out


def _clean(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, found in scan(batch.column(at)):
                for k in range(len(found.first) - 1):
                    keep[lo + k] = not block.search(found.hashes[found.first[k] : found.first[k + 1]])
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs less the documents that find_contamination finds; all columns stay, and nothing is shuffled."""
    at, out = docs.columns.index("text"), docs
    for block in _blocks(items):
        out = out.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), at), docs.schema)
    return out
