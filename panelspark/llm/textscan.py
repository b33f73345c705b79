"""Vectorised scans of Arrow string columns: words, word hashes and rolling word windows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  UTF-8 continuation bytes are never in
that set, so the byte runs are exactly the matches of ``[^\\x20\\x09-\\x0D]+`` on the text.
All hashes are 64 bit and depend on the content alone: every executor computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is handled alone.
SLICE_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
_P = 0xD1342543DE82EF95
_P_INV = pow(_P, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection of the 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _randoms(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


_TABLE = _randoms(1 << 12)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, dtype=np.uint64)


class Words(NamedTuple):
    """Words of several texts: byte range, hash, and the words before each text (n + 1 offsets)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if offsets is None or n == 0:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows with about ``most`` bytes of text: (rows, bytes, offsets)."""
    data, offs = string_buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    """All words of the texts with their hashes; ``lower`` folds A-Z first."""
    n_docs = len(offs) - 1
    none = np.empty(0, np.int64)
    if len(data) == 0:
        return Words(none, none, np.empty(0, np.uint64), np.zeros(n_docs + 1, np.int64))
    solid = ~_SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    filled = offs[:-1][offs[1:] > offs[:-1]]
    starts[filled] = solid[filled]
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    ends[last] = solid[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offs).astype(np.int64)
    if len(start) == 0:
        return Words(none, none, np.empty(0, np.uint64), first)
    length = end - start
    base = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(base, length)
    longest = int(length.max())
    table = _TABLE if longest <= len(_TABLE) else _randoms(longest)
    with np.errstate(over="ignore"):
        terms = table[place]
        terms *= (_LOWER if lower else _SAME)[data[solid]].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(terms, base)
        return Words(start, end, mix(sums + length.astype(np.uint64) * _GOLD), first)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries: len(hashes) - n + 1 values, none if shorter."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * _powers(_P, len(hashes)), out=sums[1:])
        return mix((sums[n:] - sums[:m]) * _powers(_P_INV, m) + np.uint64(n) * _GOLD)


def doc_windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``n`` words that lie within one text: (index of the first word, hash)."""
    all_hashes = windows(w.hash, n)
    at = np.arange(len(all_hashes), dtype=np.int64)
    doc_end = np.repeat(w.first[1:], np.diff(w.first))[: len(all_hashes)]
    inside = at + n <= doc_end
    return at[inside], all_hashes[inside]


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, as Spark keeps them."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
