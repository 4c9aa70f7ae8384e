"""SentencePiece encoding through a table of distinct marked words, and decoding.

A text is normalised by the library and cut where no piece of the vocabulary can reach
across: before a run of word markers, and around line breaks. Blocks of texts keep each
chunk once and the texts as places in that list; all blocks' chunks meet in one table
of distinct chunks, each of which is segmented once; its ids go back to the blocks that
hold it, where the texts are put together by place.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vidlake.llm.storage import save_bucketed, shuffle_partitions

MARK = "▁"
#: Code points of text that share one list of chunks.
BLOCK = 1 << 24
#: Texts that are decoded at once.
DECODED_ROWS = 500
_models: dict[str, tuple] = {}


def chunk_pattern(pieces: list[str]) -> str:
    """What cuts a normalised text into parts that no piece reaches across: the text as a whole where pieces can.

    Merging joins neighbours whose joint text is a piece. Where no piece has a marker
    after another character, none reaches from a word into the markers of the next;
    where none has a line break beside another character, none reaches across those.
    """
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return r"(?s).+"
    if any("\n" in p and p != "\n" for p in pieces):
        return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
    return f"\n|{MARK}*[^{MARK}\n]+|{MARK}+"


def load_model(path: str):
    """(processor of the file, processor that takes text as already normalised, chunk pattern); kept for the life of a worker."""
    if path not in _models:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            content = f.read()
        own = sentencepiece.SentencePieceProcessor(model_proto=content)
        proto = sentencepiece_model_pb2.ModelProto.FromString(content)
        # user-defined symbols are matched before merging, so they can reach across as pieces can
        pattern = chunk_pattern([p.piece for p in proto.pieces if p.type in (proto.SentencePiece.NORMAL, proto.SentencePiece.USER_DEFINED)])
        if not proto.trainer_spec.byte_fallback or proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            pattern = r"(?s).+"  # neighbouring unknowns become one, and other models weigh the text as a whole
        spec = proto.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        _models[path] = own, sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), re.compile(pattern)
    return _models[path]


class _Codes(dict):
    """Numbers of what is looked up, in order of first appearance."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 in few bytes: their bytes by significance, compressed."""
    return zstandard.compress(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def _unpacked(content: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(content), "u1").reshape(4, -1).T).view("<u4").ravel()


def _cut(path: str, block: int, homes: int):
    """A task's function: a block after another, rows of its chunks by their home, and rows of its texts as places.

    A home's chunks are one text and the lengths of its parts. Places count through the
    block's homes in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, pattern = load_model(path)
        number, size, codes, known, texts = TaskContext.get().partitionId() << 32, 0, _Codes(), {}, []

        def close() -> pa.RecordBatch:
            chunks = sorted(codes)  # neighbours that are alike, and their ids, pack better
            home = np.fromiter((zlib.crc32(c.encode()) % homes for c in chunks), np.int64, len(chunks))
            order = np.argsort(home, kind="stable")
            place = np.empty(len(order), "<u4")
            place[np.fromiter((codes[chunks[k]] for k in order), np.int64, len(order))] = np.arange(len(order))
            cuts = np.flatnonzero(np.diff(home[order])) + 1
            lists = [[chunks[k] for k in part] for part in np.split(order, cuts)] if chunks else []
            n, m = len(lists), len(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * (n + m), pa.int64()), pa.array([*(int(home[order[k]]) for k in [0, *cuts][:n]), *[None] * m], pa.int32()),
                    pa.array([*(_packed(np.fromiter(map(len, x), "<u4", len(x))) for x in lists), *[None] * m], pa.binary()), pa.array([*(zstandard.compress("".join(x).encode(), 1) for x in lists), *[None] * m], pa.binary()),
                    pa.array([*[None] * n, *(t[0] for t in texts)], pa.int64()), pa.array([*[None] * n, *(_packed(place[t[1]]) for t in texts)], pa.binary()),
                ],
                names=["block", "home", "sizes", "chunks", "doc_id", "places"],
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""  # one at a time: a batch's texts are many
                same = hashlib.blake2b(text.encode(), digest_size=16).digest()
                if same not in known:
                    found = pattern.findall(own.normalize(text))
                    known[same] = np.fromiter(map(codes.__getitem__, found), np.uint32, len(found))
                texts.append((doc, known[same]))
                size += len(text)
                if size >= block:
                    yield close()
                    number, size, codes, known, texts = number + 1, 0, _Codes(), {}, []
        if texts:
            yield close()

    return run


def _segment(path: str):
    """A task's function over rows sorted by home: the ids of each block's chunks there, every distinct chunk segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, at, table = load_model(path)[1], None, {}
        for batch in batches:
            blocks, sizes, out = [], [], []
            for block, home, lengths, chunks in zip(*(batch.column(c).to_pylist() for c in ("block", "home", "sizes", "chunks"))):
                if home != at:
                    at, table = home, {}
                ends, chunks = np.cumsum(_unpacked(lengths), dtype=np.int64).tolist(), zstandard.decompress(chunks).decode()
                parts = [chunks[a:b] for a, b in zip([0, *ends], ends)]
                new = [c for c in dict.fromkeys(parts) if c not in table]
                table.update(zip(new, (np.array(ids, "<u2" if max(ids, default=0) < 1 << 16 else "<u4") for ids in plain.encode(new, num_threads=1))) if new else ())
                ids = [table[c] for c in parts]
                blocks.append((block, home))
                sizes.append(_packed(np.fromiter(map(len, ids), "<u4", len(ids))))
                out.append(_packed(np.concatenate(ids)))
            columns = [pa.array([b for b, _ in blocks], pa.int64()), pa.array([h for _, h in blocks], pa.int32()), pa.array(sizes, pa.binary()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "home", "sizes", "ids"])

    return run


def _put_together(path: str, begin: bool, end: bool, decoded: bool):
    """A function of a block's texts and its chunks' ids: the ids of each text, and what they decode to."""

    def run(texts: pa.Table, lists: pa.Table) -> pa.Table:
        own = load_model(path)[0]
        head, tail = np.array([own.bos_id()] * begin, "<u4"), np.array([own.eos_id()] * end, "<u4")
        lists = lists.sort_by("home")
        flat = np.concatenate([np.zeros(0, "<u4"), *map(_unpacked, lists.column("ids").to_pylist())])
        sizes = np.concatenate([np.zeros(0, "<u4"), *map(_unpacked, lists.column("sizes").to_pylist())]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        out, back = [], []
        for places in texts.column("places"):
            at = _unpacked(places.as_py())
            counts = sizes[at]
            # where each id lies: its chunk's start, and how far it is from the chunk's first
            place = np.arange(counts.sum()) + np.repeat(starts[at] - np.cumsum(counts) + counts, counts)
            ids = np.concatenate([head, flat[place], tail]).astype("<u4")
            out.append(ids.tobytes())
            if decoded:
                back.append(own.decode(ids.tolist()))
        columns = {"doc_id": texts.column("doc_id"), "ids": pa.array(out, pa.binary())}
        return pa.table(columns | ({"decoded": pa.array(back, pa.string())} if decoded else {}))

    return run


def encode_pieces(docs: DataFrame, model: str, begin: bool = True, end: bool = True, block: int = BLOCK, decoded: bool = False) -> DataFrame:
    """(doc_id, ids[, decoded]) of every row of docs: the library's ids of the whole text, little-endian unsigned 32-bit.

    A null text is encoded as an empty one, which has the begin and end ids alone. Rows
    that repeat a doc_id, or have none, are encoded like any other; an empty table gives
    no rows; other columns are not looked at. model: path of a .model file on every
    machine. A text without markers or line breaks is one chunk, however long.
    decoded: also the library's text of the ids, by the task that has put them together.

    The table of distinct chunks lies by home, a hash: blocks send each home their
    chunks there, of which a frequent one is one a block, and get ids back. Texts stay
    where their block was written, in its bucket; only chunks and ids are shuffled.
    """
    n = shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "block long, home int, sizes binary, chunks binary, doc_id long, places binary"
    cut = save_bucketed(docs.mapInArrow(_cut(model, block, 2 * n), kinds), "chunks", "block", in_place=True)
    lists = cut.where("home is not null").select("block", "home", "sizes", "chunks").repartition(n, "home").sortWithinPartitions("home", "block")
    ids = lists.mapInArrow(_segment(model), "block long, home int, sizes binary, ids binary")
    texts = cut.where("places is not null").select("block", "doc_id", "places")
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_put_together(model, begin, end, decoded), "doc_id long, ids binary" + (", decoded string" if decoded else ""))


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids): the library's text of the ids; null where ids are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load_model(model)[0]
        for batch in batches:
            for at in range(0, len(batch), DECODED_ROWS):  # a batch's texts are many
                part = batch.slice(at, DECODED_ROWS)
                texts = [None if ids is None else own.decode(np.frombuffer(ids, "<u4").tolist()) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def encoded_and_decoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs."""
    out = encode_pieces(docs, model, decoded=True)
    return out.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
