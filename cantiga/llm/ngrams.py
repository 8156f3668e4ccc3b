"""Hashed word and byte n-grams of texts: the features of both classifiers."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .columns import U, Words, total, windows

#: Buckets of word 1- and 2-grams, and as many of byte 3-grams.
BUCKETS = 1 << 16


class Grams(NamedTuple):
    word: np.ndarray  #: buckets of the word n-grams of all rows
    word_row: np.ndarray
    byte: np.ndarray  #: buckets of the byte n-grams of all rows
    byte_row_bounds: np.ndarray  #: the byte n-grams of row i


def grams(offsets: np.ndarray, data: np.ndarray, w: Words) -> Grams:
    pairs, at = windows(w.hashes, w.bounds, 2, short=False)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(w.bounds))
    x = data.astype(np.uint32)
    n = max(0, len(x) - 2)
    code = ((x[:n] | (x[1 : n + 1] << 8) | (x[2 : n + 2] << 16)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inner = np.ones(n, bool)  # a 3-gram belongs to one row
    cuts = offsets[1:-1]
    for j in (1, 2):
        c = cuts - j
        inner[c[(c >= 0) & (c < n)]] = False
    bounds = np.minimum(offsets, n)
    bounds = np.concatenate(([0], np.cumsum(total(inner.astype(np.int64), bounds))))
    return Grams(np.concatenate(((w.hashes >> U(48)).astype(np.int32), (pairs >> U(48)).astype(np.int32))), np.concatenate((row, row[at])), code[inner].astype(np.int32), bounds)


def sums(g: Grams, word_weight: np.ndarray, byte_weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the sum of the word n-grams' weights, their number, and the same of the byte n-grams."""
    return (np.bincount(g.word_row, word_weight[g.word], rows), np.bincount(g.word_row, minlength=rows), total(byte_weight[g.byte].astype(np.float64), g.byte_row_bounds), np.diff(g.byte_row_bounds))
