"""Columnar text kernels: from an Arrow string column to word hashes and shingle sets, without a Python loop per word.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64-bit and the same in every process.
Arrays built here are a small multiple of the bytes handed in, so callers cut batches with :func:`pieces` first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once.
PIECE_BYTES = 1 << 16

_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def key(*parts: int) -> np.uint64:
    """A 64-bit constant from small integers."""
    out = np.zeros(1, U)
    for p in parts:
        out = mix(out + np.array([p & 0xFFFFFFFFFFFFFFFF], U) + U(_STEP))
    return out[0]


_powers = [np.ones(1, U), np.ones(1, U)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(max(n, PIECE_BYTES + 1), base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _power(j: int) -> np.uint64:
    return U(pow(_STEP, j, 1 << 64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 (one more than rows) and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes and `rows` rows each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def is_space(data: np.ndarray) -> np.ndarray:
    return ((data - np.uint8(9)) < 5) | (data == 32)


def folded(data: np.ndarray) -> np.ndarray:
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << 5)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """With it, `(sums[b] - sums[a]) * down[a]` is a polynomial of the bytes a to b alone; see `span_hashes`."""
    n = len(data)
    value, total = np.empty(n, U), np.empty(n + 1, U)
    total[0] = 0
    np.add(data, U(1), out=value)
    value *= _grown(n + 1)[0][:-1]
    np.cumsum(value, out=total[1:])
    return total


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _grown(len(sums))[1][starts])


class Words(NamedTuple):
    hashes: np.ndarray  #: of each word
    bounds: np.ndarray  #: the words of row i are bounds[i]:bounds[i + 1]
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word


def words(offsets: np.ndarray, data: np.ndarray, fold: bool = True) -> Words:
    """Every word of every row. fold: A-Z count as a-z."""
    n = len(data)
    inside = ~is_space(data)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(span_hashes(prefix_sums(folded(data) if fold else data), starts, ends), np.searchsorted(starts, offsets), starts, ends)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k words inside a row, and its first word. short: a row of fewer words, but one at least, has one window of all its words."""
    n = len(hashes)
    full = np.ones(n, bool)
    lo, hi = bounds[:-1], bounds[1:]
    for j in range(1, k):
        at = hi - j
        full[at[at >= lo]] = False
    out = np.zeros(n, U)
    for j in range(min(k, n)):
        out[: n - j] += hashes[j:] * _power(j)
    if short:
        few = np.flatnonzero((hi - lo < k) & (hi > lo))
        if len(few):
            first, size = lo[few], (hi - lo)[few]
            total = size.astype(U) * key(k)
            for j in range(k - 1):
                has = size > j
                total[has] += hashes[first[has] + j] * _power(j)
            out[first] = total
            full[first] = True
    at = np.flatnonzero(full)
    return mix(out[at]), at


class Sets(NamedTuple):
    values: np.ndarray  #: 48-bit values, ascending in each row, each once
    bounds: np.ndarray  #: the values of row i are bounds[i]:bounds[i + 1]


def sets(hashes: np.ndarray, row: np.ndarray, rows: int) -> Sets:
    """The distinct hashes of each row, cut to 48 bits. row: of each hash, ascending."""
    if rows > 1 << 16:
        cut = int(np.searchsorted(row, 1 << 16))
        a, b = sets(hashes[:cut], row[:cut], 1 << 16), sets(hashes[cut:], row[cut:] - (1 << 16), rows - (1 << 16))
        return Sets(np.concatenate((a.values, b.values)), np.concatenate((a.bounds, b.bounds[1:] + a.bounds[-1])))
    full = (row.astype(U) << U(48)) | (hashes >> U(16))
    full.sort()
    if len(full):
        full = full[np.concatenate(([True], full[1:] != full[:-1]))]
    bounds = np.searchsorted(full, np.arange(rows, dtype=U) << U(48))
    return Sets(full & U((1 << 48) - 1), np.append(bounds, len(full)))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> Sets:
    """Each row's set of k-word shingles, A-Z as a-z; with fewer words the whole sequence, without words nothing."""
    w = words(offsets, data)
    h, at = windows(w.hashes, w.bounds, k, short=True)
    return sets(h, np.searchsorted(w.bounds, at, "right") - 1, len(offsets) - 1)


def total(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each row's values, modulo 2**64 for integers."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


class Index:
    """From 64-bit keys, each once, to their places: open addressing with all lookups of a batch side by side."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._at(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(_STEP)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._at(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.slots[at[wrong]]
            now = out[wrong]
            wrong = wrong[(now >= 0) & (self.keys[now] != keys[wrong])]
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(signed(np.ascontiguousarray(x)) if x.dtype == U else x.astype(np.int64, copy=False), pa.int64())
