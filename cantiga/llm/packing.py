"""Packing of tokenised documents into windows: best-fit decreasing over a segment tree of remaining capacities.

Each input partition packs its own documents in one pass without a shuffle: full windows leave at once, remainders wait, as
numbers, for a bounded block that is packed together. A retried task makes the same rows, as sequence ids are made of the
partition's number and a count.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import U, buffers, pieces, prefix_sums, span_hashes
from .runtime import documents

WINDOW = 1024
#: Remainders that are packed together. Memory is some 100 bytes each.
BLOCK = 1 << 16
#: Distinct parts of words whose ids a worker remembers, and parts of how many bytes at most.
MEMO, MEMO_BYTES = 500_000, 64
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

# Fixed values of the byte-level vocabulary's pre-tokeniser, whose pattern is
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# and its printable stand-ins for bytes.
_SHORT, _LONG = b"stmd", (b"re", b"ve", b"ll")
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER_SPACE = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"

_SPACE, _LETTER, _NUMBER, _MARK, _RARE = range(5)


def _class(code: int) -> int:
    """What the pre-tokeniser takes a character for; rare ones, of which versions of Unicode may differ, are left to the library."""
    c = chr(code)
    if c in " \t\n\r\x0b\x0c":
        return _SPACE
    if re.match(f"[{_OTHER_SPACE}]", c) or 0x250 <= code < 0x2010:
        return _RARE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _MARK)


_CLASS = np.array([_class(k) for k in range(0x2060)], np.uint8)
_BYTE_CLASS = np.append(_CLASS[:0x80], np.full(0x80, _RARE, np.uint8))
_STAND_IN = np.zeros(256, np.uint16)
_STAND_IN[_PRINTABLE] = _PRINTABLE
_STAND_IN[_STAND_IN == 0] = 0x100 + np.arange(256 - len(_PRINTABLE))


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = _BYTE_CLASS[data]
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    code = ((data[two].astype(np.int64) & 0x1F) << 6) | (data[two + 1] & 0x3F)
    out[two] = out[two + 1] = _CLASS[code]
    three = np.flatnonzero(data == 0xE2)
    code = ((data[three + 1].astype(np.int64) & 0x3F) << 6) | (data[three + 2] & 0x3F) | 0x2000
    three, code = three[code < len(_CLASS)], code[code < len(_CLASS)]
    out[three] = out[three + 1] = out[three + 2] = _CLASS[code]
    return out


def parts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each part that the pre-tokeniser makes of the texts, and whether it is for the library to encode.

    A word with rare characters, and the white space before it, is one such part.
    """
    n = len(data)
    kind, first = _classes(data), np.zeros(n + 3, bool)
    first[offsets] = True
    space = kind == _SPACE
    begin = first[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # of white space before a word the last character is a part of its own, or, if it is a blank, begins the word's
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    begin[last] = True
    begin[last[data[last] == 32] + 1] = False
    mark = np.flatnonzero((data == 39) & begin)
    mark = mark[~first[mark + 1]]
    after = np.append(data, np.zeros(2, np.uint8))
    short = mark[np.isin(after[mark + 1], np.frombuffer(_SHORT, np.uint8))]
    pair = (after[mark + 1].astype(np.uint16) << 8) | after[mark + 2]
    long = mark[np.isin(pair, [int.from_bytes(x) for x in _LONG]) & ~first[mark + 2]]
    for at, size in ((short, 2), (long, 3)):
        begin[at + 1] = False
        begin[(at + size)[at + size < n]] = True
    rare = kind == _RARE
    if not rare.any():
        starts = np.flatnonzero(begin)
        return starts, np.zeros(len(starts), bool)
    word = first[:n].copy()
    word[1:] |= space[1:] & ~space[:-1]
    which = np.cumsum(word) - 1
    odd = np.zeros(which[-1] + 1, bool)
    odd[which[rare]] = True
    odd = odd[which]
    starts = np.flatnonzero(np.where(odd, word, begin))
    return starts, odd[starts]


class Encoder:
    """Ids of a column of texts, as the library's unaltered tokeniser gives them.

    The pre-tokeniser's parts are found in numpy and told apart by 64-bit hashes of their bytes; each distinct one is encoded once
    by the library's model, all others are gathered. What is remembered is bounded, and forgotten as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that are encoded whole: rare white space before other white space, or a special string.
        self.whole = "|".join([f"[{_OTHER_SPACE}][ \t\n\r\x0b\x0c]", *special])
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by `END_ID`, and the bounds of each text's ids."""
        offsets, data = buffers(texts)
        if len(self.slots) > MEMO or len(self.ids) > 16 * MEMO:
            self._forget()
        starts, odd = parts(offsets, data) if len(data) else (np.zeros(0, np.int64), np.zeros(0, bool))
        entire = np.flatnonzero(pc.match_substring_regex(texts, self.whole).fill_null(False).to_numpy(zero_copy_only=False))
        if len(entire):
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, offsets[entire] + 1, 1)
            np.add.at(inside, offsets[entire + 1], -1)
            keep = np.cumsum(inside)[starts] == 0
            starts, odd = starts[keep], odd[keep]
            odd[np.searchsorted(starts, offsets[entire])] = True
        ends = np.append(starts[1:], len(data))
        alone = odd | (ends - starts > MEMO_BYTES)
        common = np.flatnonzero(~alone)
        hashes = np.zeros(len(common), U)
        for lo, hi in pieces(np.append(starts, len(data)), 1 << 20, len(starts) + 1):  # parts of one piece
            a, b = np.searchsorted(common, (lo, hi))
            if a < b:
                span = data[starts[lo] : ends[hi - 1]]
                hashes[a:b] = span_hashes(prefix_sums(span), starts[common[a:b]] - starts[lo], ends[common[a:b]] - starts[lo])
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.array([self.slots.get(h, -1) for h in distinct.tolist()], np.int64)
        fresh = np.flatnonzero(known < 0)
        known[fresh] = len(self.bounds) - 1 + np.arange(len(fresh))
        self.slots.update(zip(distinct[fresh].tolist(), known[fresh].tolist(), strict=True))
        single = np.flatnonzero(alone)
        slot = np.zeros(len(starts), np.int64)
        slot[common] = known[inverse]
        slot[single] = len(self.bounds) - 1 + len(fresh) + np.arange(len(single))
        self._learn(data, starts, ends, np.append(common[at[fresh]], single), odd)

        size = self.bounds[slot + 1] - self.bounds[slot]
        reach = np.concatenate(([0], np.cumsum(size)))
        row = reach[np.searchsorted(starts, offsets)]  # ids before each row, without ends
        place = np.arange(reach[-1]) + np.repeat(self.bounds[slot] - reach[:-1], size)
        bounds = row + np.arange(len(row))
        out = np.full(bounds[-1], END_ID, np.int32)
        out[np.arange(reach[-1]) + np.repeat(np.arange(len(row) - 1), np.diff(row))] = self.ids[place]
        return out, bounds

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, odd: np.ndarray) -> None:
        """Adds the ids of some parts, in order, behind those known."""
        size = (ends - starts)[which]
        to = np.cumsum(size)
        at = np.arange(size.sum()) + np.repeat(starts[which] - (to - size), size)
        seen = _STAND_IN[data[at]].tobytes().decode("utf-16-le")
        ids, counts, tokenize = [], [], self.tokenizer.model.tokenize
        for k, a, b, o in zip(which.tolist(), (to - size).tolist(), to.tolist(), odd[which].tolist(), strict=True):
            if o:
                more = self.tokenizer.encode(data[starts[k] : ends[k]].tobytes().decode(), add_special_tokens=False).ids
            else:
                more = [t.id for t in tokenize(seen[a:b])]
            ids += more
            counts.append(len(more))
        self.ids = np.append(self.ids, np.array(ids, np.int32))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(np.array(counts, np.int64)))


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


class Capacities:
    """A segment tree over the remaining capacities 0..size-1: how many open windows have each."""

    def __init__(self, size: int):
        self.base = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(self.base)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        k = capacity + self.base
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Capacity and number of the tightest open window that has room for `least`, which is then no longer open."""
        count, k = self.count, least + self.base
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up, until a subtree to the right has a window
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.base
        while k:
            count[k] -= 1
            k >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each length (1..size), the longest first; and the number of windows."""
    window, offset, used = [0] * len(lengths), [0] * len(lengths), 0
    tree = Capacities(size)
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        got = tree.take(n) if n < size else None
        left, w = got or (size, used)
        used += got is None
        window[i], offset[i] = w, size - left
        if left > n:
            tree.put(left - n, w)
    return window, offset, used


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts in the document, its length, and where it lies in which sequence.

    Each text's ids are the library's, special strings included, followed by id 0; a null or empty text is that id alone. Documents of more than `window` ids are first
    cut into full windows. with_ids adds the piece's ids (array of int). Repeated rows are packed each; an empty table gives no
    rows. Columns but doc_id and text are not read.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = _encoder(tokenizer), TaskContext.get().partitionId() << 33
        done: list[tuple] = []
        waiting: list[tuple] = []

        def flush() -> None:
            nonlocal made
            where, at, used = best_fit([r[2] for r in waiting], window)
            done.extend((*r[:5], made + w, o, *r[5:]) for r, w, o in zip(waiting, where, at, strict=True))
            made += used
            waiting.clear()

        def rows() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done, strict=True)]
            done.clear()
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            offsets, _ = buffers(b.column("text"))
            for lo, hi in pieces(offsets, 1 << 20):
                part = b.slice(lo, hi - lo)
                ids, bounds = encoder.encode(part.column("text"))
                raw = memoryview(ids.astype("<i4", copy=False).tobytes())
                for doc, first, end in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for at in range(first, end, window):
                        size = min(window, end - at)
                        more = (ids[at : at + size],) if with_ids else ()
                        row = (doc, at - first, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), end - first)
                        if size == window:
                            done.append((*row, made, 0, *more))
                            made += 1
                        else:
                            waiting.append((*row, *more))
                if len(waiting) >= BLOCK:
                    flush()
                if len(done) >= 1 << 14:
                    yield rows()
        flush()
        if done:
            yield rows()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
