"""Substring dedup: passages that repeat across documents, by MinHash banding of paragraphs.

A paragraph is a line of MIN_WORDS words or more: BANDS bands of its MinHash values are
its keys, and paragraphs that share a band are compared by exact Jaccard similarity.
Every text of more than LONG words is also read as overlapping paragraphs of UNIT
words (units) that start where a shingle hash is the least of a run of RUN (one
MinHash of the neighbourhood), over the words of the whole text whatever its lines, so
that a passage is found too where it is wrapped otherwise or pasted into the middle of
a line. A unit's key is the sequence of its first words: of two units with one key all
but the last UNIT - HEAD - WORDS + 1 words are equal, so their word edit distance, and
with no repeated shingle their Jaccard similarity, is within the bound by itself. Linked
paragraphs form components; in each, the smallest doc_id keeps its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vidlake.llm import setjoin
from vidlake.llm.storage import drop, save
from vidlake.llm.textscan import grams, mix, power_tables, scan

WORDS = 5
MIN_WORDS, UNIT, LONG = 20, 32, 50
#: A passage of LONG + 1 words holds a whole unit: its first RUN shingles hold a least one.
RUN = LONG + 1 - UNIT + 1
#: Equal units one after another (in words said over and over) are taken once in so many words.
AGAIN = 16


def choose_bands(similarity: float, recall: float = 0.995, rows: int = 2) -> int:
    """Bands of `rows` MinHash values each, so that sets of this similarity share one with probability `recall`."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


ROWS = 2
BANDS = choose_bands(setjoin.NUM / setjoin.DEN, rows=ROWS)
#: Shingles that two units must share to reach the similarity.
HEAD = -(-2 * (UNIT - WORDS + 1) * setjoin.NUM // (setjoin.NUM + setjoin.DEN))
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1)
_LINE, _UNIT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Sequences:
    """Hashes of runs of shingles, each in a few steps whatever its length."""

    def __init__(self, g: np.ndarray):
        self.power, self.inverse = power_tables(len(g) + 1)
        self.total = np.zeros(len(g) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(g * self.power[: len(g)], out=self.total[1:])

    def of(self, at: np.ndarray, n: np.ndarray | int, kind: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(((self.total[at + n] - self.total[at]) * self.inverse[at]) ^ kind).view(np.int64)


def _row_of(found, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(found.first, at, side="right") - 1


def _lines(found, g: np.ndarray, runs: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first words, words, keys) of the paragraphs; keys: BANDS of each."""
    breaks = np.searchsorted(found.starts, np.flatnonzero(found.data == 10))
    edges = np.unique(np.concatenate([found.first, breaks]))
    at, size = edges[:-1], np.diff(edges)
    at, size = at[size >= MIN_WORDS], size[size >= MIN_WORDS]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, BANDS), np.int64)
    count = size - WORDS + 1
    edge = np.cumsum(count) - count
    own = g[np.arange(count.sum()) + np.repeat(at - edge, count)]
    with np.errstate(over="ignore"):
        least = np.stack([np.minimum.reduceat((own ^ a) * (b | np.uint64(1)), edge) for a, b in zip(*_SEEDS)], axis=1).reshape(-1, BANDS, ROWS)
        keys = mix(least[..., 0] * np.uint64(3) + least[..., 1] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return runs.of(at, count, _LINE), at, size, keys.view(np.int64)


def _unit_starts(found, g: np.ndarray, runs: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first words) of the units of the texts of more than LONG words."""
    counts = found.counts()
    last, long = np.repeat(found.first[1:], counts), np.repeat(counts > LONG, counts)
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least(g, RUN)
    place = np.arange(len(g))
    # no run goes on into the next text
    least[place[: len(least)] + RUN + WORDS - 1 > last[: len(least)]] = 0
    none = np.zeros(RUN - 1, np.uint64)
    chosen = ~_least(~np.concatenate([none, least, none]), RUN)
    starts = np.flatnonzero((chosen == g) & long[: len(g)] & (place + UNIT <= last[: len(g)]))
    ids, again = runs.of(starts, HEAD, _UNIT), np.zeros(len(starts), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (starts[1:] // AGAIN == starts[:-1] // AGAIN)
    return ids[~again], starts[~again]


_PLACES = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, doc_id, start, words) of each paragraph and unit (start: its first word in the document), and (h, id) for each key of a paragraph."""
    for batch in batches:
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        for lo, found in scan(batch.column("text")):
            g = grams(found.hashes, WORDS)
            if len(g) < MIN_WORDS - WORDS + 1:
                continue
            runs = Sequences(g)
            ids, at, size, keys = _lines(found, g, runs)
            unit_ids, starts = _unit_starts(found, g, runs)
            every, first = np.concatenate([ids, unit_ids]), np.concatenate([at, starts])
            words = np.concatenate([size, np.full(len(starts), UNIT)])
            row = _row_of(found, first)
            good = known[lo + row]
            doc = batch.column("doc_id").take(pa.array(lo + row[good]))
            start = (first - found.first[row])[good]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(start), pa.int64()), pa.array(every[good]), doc, pa.array(start.astype(np.int32)), pa.array(words[good].astype(np.int32))], schema=_PLACES)
            # a copy within the group of rows adds no key
            line_ok = good[: len(ids)]
            one, pick = np.unique(ids[line_ok], return_index=True)
            n = len(one) * BANDS
            yield pa.RecordBatch.from_arrays([pa.array(keys[line_ok][pick].ravel()), pa.array(np.repeat(one, BANDS)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], schema=_PLACES)


_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("after", pa.list_(pa.int32())), ("p0", pa.list_(pa.int64()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the wanted paragraphs."""
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_SETS), _SETS)], schema=_SETS)
    for batch in batches:
        wanted = batch.column("units").to_pylist()
        rows, size = [], 0
        for lo, found in scan(batch.column("text")):
            for k in range(len(found.first) - 1):
                own = found.hashes[found.first[k] : found.first[k + 1]]
                g = grams(own, WORDS)
                if not len(g) or not wanted[lo + k]:
                    continue
                runs = Sequences(g)
                for u in wanted[lo + k]:
                    count = u["words"] - WORDS + 1
                    # another row of the doc_id may be meant
                    if u["start"] + count <= len(g) and runs.of(np.array([u["start"]]), count, _LINE)[0] == u["id"]:
                        distinct = np.unique(g[u["start"] : u["start"] + count])
                        rows.append((u["id"], len(distinct), 0, [0], distinct.view(np.int64)))
                        size += len(distinct)
                if size > 1 << 19:
                    yield flush(rows)
                    rows, size = [], 0
        yield flush(rows)


def _repeats(docs: DataFrame) -> DataFrame:
    """(id, doc_id, start, words, kept_doc_id) of each paragraph and unit that several documents have; kept_doc_id: the one that keeps it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = save(docs.mapInArrow(_units, "h long, id long, doc_id long, start int, words int"), "units")
    places, keys = units.where("doc_id is not null").drop("h"), units.where("h is not null").select("h", "id")
    # what one id has is reduced where it lies: a passage that most documents hold is a row a task
    by_id = places.groupBy("id").agg(F.min(F.struct("doc_id", "start", "words")).alias("at"), F.max("doc_id").alias("hi"))
    mixed = save(keys.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h"), "mixed")
    members = save(keys.join(mixed.hint("merge"), "h", "left_semi").distinct().withColumn("r", F.lit(0)), "columns")
    drop(mixed)
    near = save(members.select("id").distinct().withColumn("near", F.lit(True)), "near")
    ids = save(by_id.join(near.hint("merge"), "id", "left").where("near or at.doc_id <> hi"), "ids")
    drop(near)
    wanted = save(ids.where("near").groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("id", "at.start", "at.words")).alias("units")), "wanted")
    sets = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("text", "units").mapInArrow(_sets, "id long, n long, last long, after array<int>, p0 array<long>")
    sets = save(sets.dropDuplicates(["id"]), "whole")
    labels = setjoin.link_components(members, sets, prefixes=False)
    for t in (wanted, sets, members):
        drop(t)
    named = save(ids.join(labels.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), "at.doc_id", "hi"), "named")
    keepers = save(named.groupBy("component").agg(F.min("doc_id").alias("kept_doc_id"), F.max("hi").alias("last")).where("kept_doc_id <> last").select("component", "kept_doc_id"), "keepers")
    of_id = save(named.join(keepers.hint("merge"), "component").select("id", "kept_doc_id"), "kept")
    for t in (ids, labels, named, keepers):
        drop(t)
    return places.join(of_id.hint("merge"), "id").select("id", "doc_id", "start", "words", "kept_doc_id")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id, kept, n_units, first_word, end_word): the spans of doc_id that repeat across documents.

    Every occurrence has its row, that of the keeper too: kept is true where doc_id is
    kept_doc_id, the smallest doc_id of a component. A span is made of repeated
    paragraphs that overlap or touch; a pair of documents has as many rows as there are
    spans with other words between. n_units: distinct starts of repeated paragraphs in
    the span; first_word and end_word (exclusive) count the words of the whole text.
    Repeats within one document are left alone. Null, empty and short texts and rows
    without doc_id repeat nothing. Rows that repeat a doc_id are one document. Other
    columns are not looked at; an empty table gives no rows.
    """
    pair = ["doc_id", "kept_doc_id"]
    units = _repeats(docs).groupBy(*pair, "start").agg(F.max(F.col("start") + F.col("words")).alias("end"))
    order = Window.partitionBy(*pair).orderBy("start")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = units.withColumn("fresh", F.coalesce((F.col("start") > reached).cast("long"), F.lit(1)))
    spans = fresh.withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy(*pair, "span").agg(F.count(F.lit(1)).alias("n_units"), F.min("start").cast("long").alias("first_word"), F.max("end").cast("long").alias("end_word"))
    return spans.select(*pair, (F.col("doc_id") == F.col("kept_doc_id")).alias("kept"), "n_units", "first_word", "end_word")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = batch.column("text").to_pylist(), [0] * len(batch)
        wanted = batch.column("_p_units").to_pylist()
        for lo, found in scan(batch.column("text")):
            for k in range(len(found.first) - 1):
                a, b = int(found.first[k]), int(found.first[k + 1])
                gone, g = np.zeros(b - a, bool), grams(found.hashes[a:b], WORDS)
                runs = Sequences(g)
                for u in wanted[lo + k] or ():
                    start, count = np.array([u["start"]]), u["words"] - WORDS + 1
                    # another row of the doc_id may be meant
                    if u["start"] + count <= len(g) and u["id"] in (runs.of(start, count, _LINE)[0], runs.of(start, min(HEAD, count), _UNIT)[0]):
                        gone[u["start"] : u["start"] + u["words"]] = True
                if not gone.any():
                    continue
                edge = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
                raw, at, kept = texts[lo + k].encode(), 0, []
                for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    kept.append(raw[at : found.starts[a + x] - found.offsets[k]])
                    at = found.ends[a + y - 1] - found.offsets[k]
                texts[lo + k], counts[lo + k] = (b"".join(kept) + raw[at:]).decode(), int(gone.sum())
        names = [n for n in batch.schema.names if n not in ("text", "_p_units")]
        columns = [*map(batch.column, names), pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_cut_words"])


def cut_passages(docs: DataFrame) -> DataFrame:
    """docs with a text without its repeated spans, and n_cut_words (which replaces a column of that name).

    The words of the spans of repeated_passages go, but for the keepers' own, from the first one's start to the
    last one's end; all else stays as it is, white space too. Rows without doc_id, and
    null and short texts, stay as they are. Other columns pass through; an empty table
    gives no rows.
    """
    docs = docs.drop("n_cut_words")
    units = _repeats(docs).where("doc_id <> kept_doc_id").groupBy(F.col("doc_id").alias("_p_doc")).agg(F.collect_set(F.struct("id", "start", "words")).alias("_p_units"))
    units = save(units, "repeats")
    both = docs.withColumn("text", F.col("text").cast("string")).join(units.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_p_doc"), "left").drop("_p_doc")
    rest = [c for c in both.columns if c not in ("text", "_p_units")]
    kind = both.select(*rest, "text").withColumn("n_cut_words", F.lit(0).cast("long")).schema
    return both.mapInArrow(_cut, kind).select(*docs.columns, "n_cut_words")
