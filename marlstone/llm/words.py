"""Vectorised word splitting and hashing straight from Arrow string buffers.

A *word* is a maximal run of non-separator bytes.  Two byte tables are offered:
``RAW`` (separators: the bytes up to 0x20) and ``FOLDED`` (ASCII letters are
lower-cased, every ASCII byte that is not a letter or digit separates; bytes
from 0x80 on belong to words).  Words never cross row boundaries; a null text
has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RAW = np.arange(256, dtype=np.uint8)
RAW[: 0x21] = 0
FOLDED = np.arange(256, dtype=np.uint8)
for _b in range(0x80):
    _c = chr(_b)
    FOLDED[_b] = ord(_c.lower()) if _c.isalnum() else 0

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], a block of bytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    w = 0
    while w < len(starts):
        first = starts[w]
        stop = max(int(np.searchsorted(ends, first + SLICE_BYTES, side="right")), w + 1)
        last = ends[stop - 1]
        power, inverse = _power_tables(int(last - first) + 1)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * power[: last - first], out=sums[1:])
        lo = starts[w:stop] - first
        out[w:stop] = (sums[ends[w:stop] - first] - sums[lo]) * inverse[lo]
        w = stop
    return mix(out)


class Slice:
    """Some rows of a batch: their bytes, words and word hashes.

    ``rows`` is the range of row numbers in the batch, ``offsets`` the byte
    offset of each row in ``data``, ``first[i]:first[i+1]`` the words of row i.
    """

    __slots__ = ("data", "ends", "first", "hashes", "mapped", "offsets", "rows", "starts")

    def __init__(self, rows: range, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
        self.rows, self.data, self.offsets = rows, data, offsets
        self.mapped = table[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = self.mapped != 0
        begins = inside[1:-1] & ~inside[:-2]
        stops = inside[1:-1] & ~inside[2:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] |= inside[1:-1][cut]
        stops[cut - 1] |= inside[1:-1][cut - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_words(self.mapped, self.starts, self.ends) if hashed else None

    def __len__(self) -> int:
        return len(self.rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return o, d


def slices(column: pa.Array, table: np.ndarray = RAW, hashed: bool = True, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a string column, grouped into slices of about ``size`` bytes."""
    offs, data = text_buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        stop = max(int(np.searchsorted(offs, offs[row] + size, side="right")) - 1, row + 1)
        own = offs[row : stop + 1]
        yield Slice(range(row, stop), data[own[0] : own[-1]], own - own[0], table, hashed)
        row = stop


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (as if the rows were one; the caller masks)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(count, dtype=np.uint64)
    for j in range(n):
        acc *= np.uint64(_BASE)
        acc += hashes[j : j + count]
    return mix(acc)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in log(width) passes."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])
    return out


class Lines:
    """Which line (separated by newline bytes) of a slice each word is in.

    ``key`` numbers the lines of the slice so that no two rows share one,
    ``number`` counts from 0 within the row; both have an entry for each word.
    """

    __slots__ = ("key", "number", "row")

    def __init__(self, s: Slice):
        newlines = np.flatnonzero(s.data == 10)
        self.row = s.row_of_word()
        before = np.searchsorted(newlines, s.starts)
        self.key = before + self.row
        self.number = before - np.searchsorted(newlines, s.offsets[:-1])[self.row]
