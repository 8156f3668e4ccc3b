"""Dense count vectors over a whole corpus, summed without a group that grows with the number of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import U, key, mix

#: Elements of a vector that travel together.
BLOCK = 8192
_SCHEMA = pa.schema([("block", pa.int32()), ("counts", pa.binary())])


def summed(df: DataFrame, columns: list[str], count: Callable[[pa.RecordBatch, np.ndarray], None], length: int, parts: int = 16) -> np.ndarray:
    """`count` adds each Arrow batch of `df` to a vector of `length` doubles; the sum over all batches comes to the driver.

    Each task sends its vector in blocks. A block's sums are added as they arrive, so memory is one vector per task
    and what reaches the driver is one vector, whatever the number of tasks.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, some = np.zeros(length), False
        for b in batches:
            count(b, into)
            some = True
        if some:
            yield from _rows((k, into[k * BLOCK : (k + 1) * BLOCK]) for k in range(-(-length // BLOCK)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(v.as_buffer(), np.float64)
                held[k] = held[k] + v if k in held else v.copy()
        yield from _rows(held.items())

    schema = "block int, counts binary"
    out = np.zeros(length)
    for r in df.select(*columns).mapInArrow(local, schema).repartition(parts, "block").mapInArrow(merge, schema).collect():
        v = np.frombuffer(r.counts, np.float64)
        out[r.block * BLOCK : r.block * BLOCK + len(v)] += v
    return out


def _rows(items) -> Iterator[pa.RecordBatch]:
    for k, v in items:
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(v, np.float64).tobytes()], pa.binary())], schema=_SCHEMA)


class Bloom:
    """A Bloom filter of 64-bit numbers as one bitmap, of `MOST_BITS` at most: beyond some 10**8 numbers it only lets more through."""

    MOST_BITS, PROBES, SPAN = 30, 4, 16

    def __init__(self, bits: int):
        self.bits = bits
        self.map = np.zeros(1 << (bits - 3), np.uint8)

    def _at(self, keys: np.ndarray) -> list[np.ndarray]:
        return [mix(keys ^ key(k, 55)) >> U(64 - self.bits) for k in range(self.PROBES)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= (self.map[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
        return out

    @classmethod
    def of(cls, ids: DataFrame, count: int, parts: int = 16) -> Bloom:
        """ids: one long column of `count` rows. Bitmaps meet in blocks, so the driver gets the bitmap alone."""
        out = cls(min(cls.MOST_BITS, max(cls.SPAN, (16 * count).bit_length())))
        bits, name = out.bits, ids.columns[0]

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = cls(bits)
            for b in batches:
                for at in mine._at(b.column(0).to_numpy().view(U)):
                    np.bitwise_or.at(mine.map, (at >> U(3)).astype(np.int64), np.uint8(1) << (at & U(7)).astype(np.uint8))
            blocks = mine.map.reshape(-1, 1 << (cls.SPAN - 3))
            for k in np.flatnonzero(blocks.any(1)):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([blocks[k].tobytes()], pa.binary())], schema=_SCHEMA)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                    v = np.frombuffer(v.as_buffer(), np.uint8)
                    held[k] = held[k] | v if k in held else v
            for k, v in held.items():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], schema=_SCHEMA)

        blocks = out.map.reshape(-1, 1 << (cls.SPAN - 3))
        for r in ids.select(name).mapInArrow(local, "block int, counts binary").repartition(parts, "block").mapInArrow(merge, "block int, counts binary").collect():
            blocks[r.block] |= np.frombuffer(r.counts, np.uint8)
        return out
