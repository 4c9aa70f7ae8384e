"""Word and shingle hashes of whole Arrow text batches, in numpy.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r; A-Z count as
a-z. Texts are hashed in slices of about SLICE bytes cut at white space, so the
working memory follows the slice, not the batch; only eight bytes a word stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_LANES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            step = min(have, n - have)
            out[have : have + step] = out[:step] * (out[have - 1] * base)
            have += step
    return out


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of an odd number and of its inverse."""
    size = max(SLICE * 2, 1 << int(n - 1).bit_length())
    if size not in _tables:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _tables[size] = _powers(_BASE, size), _powers(inverse, size)
    return _tables[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """hashes: of each word; starts, ends: its bytes; first: index of the first word of each row, and the total."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        hashes, starts, ends = [], [], []
        row_starts = offsets[:-1][np.diff(offsets) > 0]
        at = 0
        while at < n:
            to = min(n, at + SLICE)
            while to < n and not _SPACE[data[to]]:
                # a slice ends at white space: no word is cut
                gap = np.flatnonzero(_SPACE[data[to : to + 4096]])
                to = to + int(gap[0]) if len(gap) else min(n, to + 4096)
            part = _LOWER[data[at:to]]
            solid = ~_SPACE[part]
            edge = np.zeros(to - at + 1, bool)
            lo, hi = np.searchsorted(row_starts, [at, to + 1])
            edge[row_starts[lo:hi] - at] = True
            before = np.empty(to - at, bool)
            before[0] = False
            before[1:] = solid[:-1]
            s = np.flatnonzero(solid & (~before | edge[:-1]))
            after = np.empty(to - at, bool)
            after[-1] = False
            after[:-1] = solid[1:]
            e = np.flatnonzero(solid & (~after | edge[1:])) + 1
            power, inverse = power_tables(len(part) + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
                hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
            at = to
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hashes, self.starts, self.ends = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words of one row; n may be 1 to 5 or more."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
        for j in range(n):
            lane = _LANES[j % 5] * np.uint64(2 * (j // 5) + 1)
            out += words[j : len(words) - n + 1 + j] * lane
        return mix(out)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Shingle hashes in order, with repeats; fewer than n words make one shingle of all, none make none."""
    return grams(words, min(n, len(words))) if len(words) else np.zeros(0, np.uint64)


def set_hash(distinct: np.ndarray) -> np.int64:
    """64-bit identity of a set of hashes: equal for equal sets."""
    with np.errstate(over="ignore"):
        total = mix(distinct ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(distinct)) * _LANES[2]
        return mix(np.array([total], np.uint64)).view(np.int64)[0]


def row_groups(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive rows (from, to) of about `limit` bytes; a longer row stands alone."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = max(at + 1, min(to, len(offsets) - 1))
        yield at, to
        at = to


def scan(batch_text: pa.Array) -> Iterator[tuple[int, Words]]:
    """(index of the first row, words of a group of rows) for the whole column."""
    data, offsets = text_bytes(batch_text)
    for lo, hi in row_groups(offsets):
        yield lo, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
