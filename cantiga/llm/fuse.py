"""Binary fuse filters (Graf and Lemire, 2022) with 8-bit fingerprints: three places per key, built by peeling in rounds."""

from __future__ import annotations

import struct

import numpy as np

from .columns import U, key, mix


def _places(hashes: np.ndarray, segment: int, count: int) -> list[np.ndarray]:
    """Three places, in three segments that follow each other."""
    first = ((hashes >> U(32)) * U(count)) >> U(32)
    out = []
    for j in range(3):
        inside = (hashes >> U(18 * j)) & U(segment - 1) if j else (hashes * U(0x9E3779B97F4A7C15)) >> U(64 - segment.bit_length() + 1) if segment > 1 else np.zeros(len(hashes), U)
        out.append(((first + U(j)) * U(segment) + inside).astype(np.int64))
    return out


def _print(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter that holds every one of the distinct 64-bit keys, as bytes. It is never changed afterwards."""
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(2, n)) / np.log(3.33) + 2.25))))
    size = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(max(2, n))) if n > 1 else 2.0
    for seed in range(1000):
        if seed and seed % 8 == 0:
            size *= 1.1
        count = max(1, int(np.ceil(n * size / segment)) - 2)
        h = mix(keys ^ key(seed, 99))
        order = _peel(_places(h, segment, count), (count + 2) * segment)
        if order is not None:
            break
    else:
        raise ValueError("the keys aren't distinct")
    table = np.zeros((count + 2) * segment, np.uint8)
    places, mark = np.stack(_places(h, segment, count)), _print(h)
    for which, at in reversed(order):  # keys of one round have places of their own
        p = places[:, which]
        table[at] = mark[which] ^ table[p[0]] ^ table[p[1]] ^ table[p[2]] ^ table[at]
    return struct.pack("<3q", seed, segment, count) + table.tobytes()


def _peel(places: list[np.ndarray], size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the place each of them has to itself)."""
    n = len(places[0])
    degree, which = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for p in places:
        degree += np.bincount(p, minlength=size)
        np.bitwise_xor.at(which, p, np.arange(n))
    out, left = [], n
    ready = np.flatnonzero(degree == 1)
    while len(ready):
        keys, first = np.unique(which[ready], return_index=True)
        out.append((keys, ready[first]))
        left -= len(keys)
        touched = []
        for p in places:
            np.subtract.at(degree, p[keys], 1)
            np.bitwise_xor.at(which, p[keys], keys)
            touched.append(p[keys])
        touched = np.unique(np.concatenate(touched))
        ready = touched[degree[touched] == 1]
    return None if left else out


def holds(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter; true for some 0.4 % of those as well."""
    seed, segment, count = struct.unpack_from("<3q", filter_bytes)
    table = np.frombuffer(filter_bytes, np.uint8, offset=24)
    h = mix(keys ^ key(seed, 99))
    a, b, c = _places(h, segment, count)
    return table[a] ^ table[b] ^ table[c] == _print(h)
