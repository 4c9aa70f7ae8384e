"""Concatenate and cut: all documents' token ids as one row of tokens, cut into windows of equal length.

Pass one tokenizes every document where it lies and counts the tokens of each task;
prefix sums over these totals (one row a task) give every document its place in the
whole. Pass two cuts each document at the multiples of the window length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vidlake.llm.storage import save

LENGTH = 2048
END_ID = 1
#: The public pre-tokenization of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[tuple[str, bool], tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next free one."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


def merges_are_ranks(spec: dict, library) -> bool:
    """Whether merging by rank of the joined bytes gives what the file's list of merges gives.

    It does when the list is in order of the ids that its pairs join to, and every token
    of the vocabulary is made by the list itself: merging inside a span does not depend
    on what is around it, so two neighbours that join to a token are then always the
    pair that the list has for it.
    """
    vocab = spec["model"]["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ids = [vocab[x + y] for x, y in pairs]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return ids == sorted(set(ids)) and all([t.value for t in library.model.tokenize(w)] == [w] for w in vocab if w not in added)


def encoder(path: str, added: bool = True):
    """(function text -> ids, vocabulary size) of a byte-level BPE tokenizer.json; kept for the life of a worker.

    The ids are those of the tokenizers library. Where merges_are_ranks holds, tiktoken runs
    the same merges some four times as fast; a text that its pattern engine gives up on
    goes to the library. Tokens that the file adds to the vocabulary have their ids
    where a text spells them: texts that hold one go to the library too. added: False
    spells them out instead.
    """
    if (path, added) not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not added
        fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if merges_are_ranks(spec, library) else None
        size = max(ranks.values()) + len(special) + 1

        def slowly(text: str) -> np.ndarray:
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

        def encode(text: str) -> np.ndarray:
            if fast is None or added and any(t in text for t in special):
                return slowly(text)
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the engine's own panics are no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                return slowly(text)

        _encoders[path, added] = encode, size
    return _encoders[path, added]


def _tokenize(path: str, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(path, added)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        task, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, starts, counts, copies = [], [], [], {}
            for text in batch.column("text").to_pylist():
                text = text or ""
                if (own := copies.get(text)) is None:
                    found = encode(text)
                    out = np.empty(len(found) + 1, kind)
                    out[:-1], out[-1] = found, END_ID
                    own = copies[text] = out.tobytes()
                n = len(own) // int(kind[-1])
                ids.append(own)
                starts.append(start)
                counts.append(n)
                start += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([task] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "task", "from", "doc_tokens", "ids"],
            )

    return run


def _cut(length: int, path: str, with_ids: bool, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if encoder(path, added)[1] <= 1 << 16 else "<u4"
        for batch in batches:
            rows: list[tuple] = []
            for doc, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "doc_tokens", "ids"))):
                own = np.frombuffer(ids, kind).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    piece = own[start : start + size].tobytes()
                    rows.append((doc, start, size, zlib.crc32(piece), n, sequence, offset, *([piece] if with_ids else [])))
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            kinds = [pa.int64()] * 7 + ([pa.binary()] if with_ids else [])
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False, added: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of full sequences.

    Every row of docs is one document; its ids end with id 1, which is all that a null
    or empty text has. Sequences are full but for the last, which is the only one to
    pad. Rows that repeat a doc_id, or have none, are packed like any other. ids: the
    piece's ids, little-endian unsigned 32-bit. Other columns are not looked at; an
    empty table gives no pieces. tokenizer: path of a tokenizer.json, on every machine.
    added: as in encoder.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = save(docs.mapInArrow(_tokenize(tokenizer, added), "doc_id long, task long, `from` long, doc_tokens long, ids binary"), "tokens", codec="zstd")
    totals = tokens.groupBy("task").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row for each task of pass one, whatever the size of its documents
    placed = tokens.join(F.broadcast(bases), "task").select("doc_id", (F.col("base") + F.col("from")).alias("at"), "doc_tokens", "ids")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_cut(length, tokenizer, with_ids, added), kinds + (", ids binary" if with_ids else ""))
