"""Substring deduplication over paragraphs.

A paragraph is a line; a line of more than `LONG` words is cut where the hash of a word triple is the least among its
neighbours, so a passage inside it is cut alike wherever it stands. Paragraphs have MinHash bands tuned for a recall; those that
collide in a band are joined and compared exactly by the Jaccard similarity of their 5-word shingles, and linked paragraphs
form components. A component in several documents is repeated text: every occurrence but its first is to be removed.

Beside the paragraphs, wherever lines end, windows of words are compared exactly. The least of some neighbouring windows is an
anchor, so a long enough run of equal words has a common anchor wherever it stands. Where a document's repeated anchors end, all
windows nearby are looked up in all documents, so that a passage reaches to its last equal word.

Paragraphs and windows are known by keys. What several documents have is found by sums over keys, of which each batch of texts sends
one row each; where they stand is read in a last pass. So a passage that a third of all documents have is a few rows until then, and
its places are spread when they meet their key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import U, Sets, Words, buffers, key, long_array, mix, pieces, sets, signed, windows, words
from .jaccard import BUCKET, SHARED, STARS, Likeness, chosen, connect, identities, packed_stars, shared_of
from .runtime import Workspace, documents
from .stats import Bloom

SHINGLE = 5
#: Words of a paragraph that is not cut, and the word triples on either side that a cut is the least of.
LONG, REACH = 100, 5
#: Shorter runs of repeated words are left alone. So passages of over 50 words are found even if, at either end, a word has grown
#: together with what stands beside it.
LEAST_WORDS = 48
RECALL = 0.99
#: Words of text for each partition of passages, and places of repeated paragraphs and windows that are put together at once, about.
BUCKET_WORDS, UNITS = 4_000_000, 1 << 16
#: Stands for a missing id: rows without one are one document that comes after all others.
NO_ID = (1 << 63) - 1
_ODD = U(1)


def tune(similarity: float, recall: float, most: int = 24) -> tuple[int, int]:
    """Bands and rows: the most selective of at most `most` hashes that catch the similarity with the recall."""
    for rows in range(8, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    return most, 1


def paragraphs(offsets: np.ndarray, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each paragraph, in order and closed by the number of words, and the paragraphs of each row as bounds."""
    n = len(w.hashes)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    lines = np.concatenate((offsets[:-1], np.flatnonzero(data == 10)))
    first = np.unique(np.searchsorted(w.starts, lines))
    first = first[first < n]
    size = np.diff(np.append(first, n))
    long = np.flatnonzero(size > LONG)
    if len(long):
        h, at = windows(w.hashes, w.bounds, 3, short=False)
        triple = np.full(n, np.iinfo(np.uint64).max, U)
        triple[at] = h
        wide = np.pad(triple, REACH, constant_values=np.iinfo(np.uint64).max)
        least = np.lib.stride_tricks.sliding_window_view(wide, 2 * REACH + 1).min(1)
        cut = np.flatnonzero((triple == least) & np.repeat(size > LONG, size) & (triple != np.iinfo(np.uint64).max))
        first = np.unique(np.concatenate((first, cut)))
    return np.append(first, n), np.searchsorted(first, w.bounds)


def _paragraph_sets(w: Words, first: np.ndarray) -> Sets:
    h, at = windows(w.hashes, first, SHINGLE, short=True)
    return sets(h, np.searchsorted(first, at, "right") - 1, len(first) - 1)


def _numbers(s: Sets) -> np.ndarray:
    """Keys of paragraphs; those of windows are odd."""
    return identities(s)[0] & ~_ODD


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """A row has fewer paragraphs than bytes, and 65 536 are handled at once."""
    return pieces(offsets, 1 << 16)


def band_hashes(s: Sets, bands: int, rows: int) -> np.ndarray:
    """MinHash signatures, paragraphs by bands."""
    some = np.diff(s.bounds) > 0
    at = s.bounds[:-1][some]
    out = np.zeros((len(some), bands), U)
    base = mix(s.values ^ key(31))
    for band in range(bands):
        code = np.full(int(some.sum()), key(32, band), U)
        for r in range(rows):
            code = mix(code ^ np.minimum.reduceat(base * (key(33, band * rows + r) | U(1)), at)) if len(at) else code
        out[some, band] = code
    return out


def _banded(documents: DataFrame, bands: int, rows: int, buckets: int) -> DataFrame:
    """Band hashes and keys of the paragraphs of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers(b.column("text"))
            number, code = [np.zeros(0, U)], [np.zeros((0, bands), U)]
            for lo, hi in _pieces(offsets):
                o, d = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                w = words(o, d)
                s = _paragraph_sets(w, paragraphs(o, d, w)[0])
                own, at = np.unique(_numbers(s), return_index=True)
                number.append(own)
                code.append(band_hashes(s, bands, rows)[at])
            number, at = np.unique(np.concatenate(number), return_index=True)
            yield packed_stars(np.stack((np.concatenate(code)[at].ravel(), np.repeat(number, bands)), 1), buckets)

    return documents.select("text").mapInArrow(run, STARS)


def _sets_of(documents: DataFrame, wanted: Bloom, bits: bool) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers(b.column("text"))
            for lo, hi in _pieces(offsets):
                o, d = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                w = words(o, d)
                s = _paragraph_sets(w, paragraphs(o, d, w)[0])
                yield chosen(s, _numbers(s), sent.value, bits)

    return documents.select("text").mapInArrow(run, "id long, n long, set binary")


def reach(least_words: int) -> tuple[int, int]:
    """Words of a window, and the windows of which the least is an anchor: `least_words` words have one, and neighbouring anchors' windows meet."""
    return (least_words + 2) // 2, least_words + 1 - (least_words + 2) // 2


def _slid(f: np.ufunc, x: np.ndarray, many: int) -> np.ndarray:
    """f over each `many` neighbours."""
    span = 1
    while span < many:
        step = min(span, many - span)
        x = f(x[:-step], x[step:])
        span += step
    return x


def anchors(h: np.ndarray, row: np.ndarray, among: int) -> np.ndarray:
    """Whether a window is the least of some `among` neighbouring windows of its row. row: of each window, ascending."""
    if len(h) < among:
        return np.zeros(len(h), bool)
    least = np.where(row[: len(h) - among + 1] == row[among - 1 :], _slid(np.minimum, h, among), U(0))
    return _slid(np.maximum, np.pad(least, among - 1), among) == h


class Piece(NamedTuple):
    """Some rows of a batch and their windows."""

    low: int  #: number of the first row in the batch
    offsets: np.ndarray
    data: np.ndarray
    words: Words
    key: np.ndarray  #: of each window
    at: np.ndarray  #: its first word
    row: np.ndarray  #: its row


def _windows(b: pa.RecordBatch, k: int) -> Iterator[Piece]:
    offsets, data = buffers(b.column("text"))
    for lo, hi in _pieces(offsets):
        o, d = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        w = words(o, d)
        if len(w.hashes):
            h, at = windows(w.hashes, w.bounds, k, short=False)
            yield Piece(lo, o, d, w, h | _ODD, at, np.searchsorted(w.bounds, at, "right") - 1)


_SEEN = "key long, low long, high long, n long"


def _seen(keys: list[np.ndarray], rows: list[np.ndarray], docs: np.ndarray) -> pa.RecordBatch:
    """Of each key: the smallest and largest document, and the number of texts that have it."""
    keys, rows = np.concatenate([np.zeros(0, U), *keys]), np.concatenate([np.zeros(0, np.int64), *rows])
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    fresh = first | np.append(True, rows[1:] != rows[:-1])[: len(keys)]
    start, doc = np.flatnonzero(first), docs[rows]
    low, high, n = (f.reduceat(x, start) if len(start) else start for f, x in ((np.minimum, doc), (np.maximum, doc), (np.add, fresh.astype(np.int64))))
    return pa.record_batch([long_array(x) for x in (keys[start], low, high, n)], names=["key", "low", "high", "n"])


def _summed(seen: DataFrame) -> DataFrame:
    return seen.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def _keys_of(texts: DataFrame, k: int, among: int) -> DataFrame:
    """The paragraphs and anchors of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for p in _windows(b, k):
                take = anchors(p.key, p.row, among)
                first, bounds = paragraphs(p.offsets, p.data, p.words)
                number = _numbers(_paragraph_sets(p.words, first))
                keys += [p.key[take], number]
                rows += [p.low + p.row[take], p.low + np.searchsorted(bounds, np.arange(len(number)), "right") - 1]
            yield _seen(keys, rows, b.column("doc_id").to_numpy())

    return texts.mapInArrow(run, _SEEN)


def _ends_of(texts: DataFrame, repeated: Bloom, k: int, among: int) -> DataFrame:
    """(key): the windows before the first and after the last of neighbouring repeated anchors."""
    sent = texts.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, U)]
            for p in _windows(b, k):
                at = np.flatnonzero(anchors(p.key, p.row, among))
                at = at[sent.value.holds(p.key[at])]
                apart = (np.diff(at) > among) | (p.row[at[1:]] != p.row[at[:-1]])
                for side, end in ((1, np.append(apart, True)), (-1, np.append(True, apart))):
                    for step in range(1, among if len(at) else 1):
                        near = at[end] + side * step
                        inside = (near >= 0) & (near < len(p.key))
                        near, own = near[inside], at[end][inside]
                        found.append(p.key[near[p.row[near] == p.row[own]]])
            yield pa.record_batch([long_array(np.unique(np.concatenate(found)))], names=["key"])

    return texts.mapInArrow(run, "key long")


def _chosen_windows(texts: DataFrame, wanted: Bloom, k: int) -> DataFrame:
    """The windows of each batch that the filter lets through."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for p in _windows(b, k):
                take = sent.value.holds(p.key)
                keys.append(p.key[take])
                rows.append(p.low + p.row[take])
            yield _seen(keys, rows, b.column("doc_id").to_numpy())

    return texts.mapInArrow(run, _SEEN)


def _places_of(texts: DataFrame, wanted: Bloom, k: int) -> DataFrame:
    """(key, doc_id, row, span, place): where the paragraphs and windows stand that the filter lets through.

    span: first and last code point, place: first word and number of words, 32 bits each.
    """
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for b in batches:
            docs, found = b.column("doc_id").to_numpy(), []
            for p in _windows(b, k):
                first, bounds = paragraphs(p.offsets, p.data, p.words)
                number = _numbers(_paragraph_sets(p.words, first))
                keys = np.concatenate((p.key, number))
                at, size = np.concatenate((p.at, first[:-1])), np.concatenate((np.full(len(p.at), k), np.diff(first)))
                row = np.concatenate((p.row, np.searchsorted(bounds, np.arange(len(number)), "right") - 1))
                take = sent.value.holds(keys)
                keys, at, size, row = keys[take], at[take], size[take], row[take]
                code = np.concatenate(([0], np.cumsum((p.data & 0xC0) != 0x80)))
                start = code[p.offsets[row]]
                begin, end = code[p.words.starts[at]] - start, code[p.words.ends[at + size - 1]] - start
                pair = [(x.astype(U) << U(32)) | y.astype(U) for x, y in ((begin, end), (at - p.words.bounds[row], size))]
                found.append(np.stack((keys, docs[p.low + row].view(U), (base + p.low + row).astype(U), *pair)))
                if sum(f.shape[1] for f in found) > UNITS:
                    yield _placed(found)
                    found = []
            base += b.num_rows
            if found:
                yield _placed(found)

    return texts.mapInArrow(run, "key long, doc_id long, row long, span long, place long")


def _placed(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([long_array(c) for c in np.concatenate(found, 1)], names=["key", "doc_id", "row", "span", "place"])


def _unions(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first span of each union of spans that overlap or touch. Spans are in order of `begin`."""
    return np.flatnonzero(np.append(True, begin[1:] > np.maximum.accumulate(end)[:-1])[: len(begin)])


def _passages(least_words: int):
    def run(units: pa.Table) -> pa.Table:
        doc, row, span, place, first, n_docs = (units.column(c).to_numpy() for c in ("doc_id", "row", "span", "place", "first_doc_id", "n_docs"))
        names, at, rank = np.unique(row, return_index=True, return_inverse=True)
        names = doc[at]
        start, stop, number, n = span >> 32, span & 0xFFFFFFFF, place >> 32, place & 0xFFFFFFFF
        begin = (rank << 32) | number
        order = np.argsort(begin, kind="stable")
        begin, end, start, stop, doc, first, n_docs = begin[order], (begin + n)[order], start[order], stop[order], doc[order], first[order], n_docs[order]

        # runs of repeated words, long enough together
        at = _unions(begin, end)
        long = (np.maximum.reduceat(end, at) - begin[at] if len(at) else at) >= least_words
        take = np.repeat(long, np.diff(np.append(at, len(begin))))
        begin, end, start, stop, doc, first, n_docs = (x[take] for x in (begin, end, start, stop, doc, first, n_docs))
        if not len(begin):
            return pa.table([pa.array([], pa.int64())] * 6 + [pa.array([], pa.bool_())], names=_NAMES)
        at = _unions(begin, end)
        runs = np.stack((begin[at], np.maximum.reduceat(end, at), start[at], np.maximum.reduceat(stop, at)), 1)

        # what an earlier document has
        old = first != doc
        b, e = begin[old], end[old]
        at = _unions(b, e)
        if len(at):
            gone = np.stack((b[at], np.maximum.reduceat(e, at), start[old][at], np.maximum.reduceat(stop[old], at)), 1)
            least, most = np.minimum.reduceat(first[old], at), np.maximum.reduceat(n_docs[old], at)
        else:
            gone, least, most = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        # the rest of the runs
        left = np.concatenate((runs[:, [0, 2]], gone[:, [1, 3]]))
        right = np.concatenate((gone[:, [0, 2]], runs[:, [1, 3]]))
        left, right = left[np.argsort(left[:, 0], kind="stable")], right[np.argsort(right[:, 0], kind="stable")]
        some = left[:, 0] < right[:, 0]
        left, right = left[some], right[some]
        kept = np.stack((left[:, 0], right[:, 0], left[:, 1], right[:, 1]), 1)
        # where a kept paragraph begins or ends beside a removed one, the white space between is in neither
        b, e, t, p, m = (x[~old] for x in (begin, end, start, stop, n_docs))
        lo, hi = np.searchsorted(kept[:, 1], b, "right"), np.searchsorted(kept[:, 0], e, "left")
        times = np.maximum(hi - lo, 0)
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum()) if len(lo) else np.zeros(0, np.int64)
        b, e, t, p, m = (np.repeat(x, times) for x in (b, e, t, p, m))
        docs = np.zeros(len(kept), np.int64)
        np.maximum.at(docs, which, m)
        same = b == kept[which, 0]
        kept[which[same], 2] = t[same]
        same = e == kept[which, 1]
        kept[which[same], 3] = p[same]

        every = np.concatenate((kept, gone))
        own = names[every[:, 0] >> 32]
        flag = np.repeat([False, True], (len(kept), len(gone)))
        first = np.where(flag, np.concatenate((np.zeros(len(kept), np.int64), least)), own)
        known = lambda x: pa.array(x, pa.int64(), mask=x == NO_ID)
        columns = [known(own), *(long_array(np.ascontiguousarray(c)) for c in (every[:, 2], every[:, 3], every[:, 1] - every[:, 0])), known(first), long_array(np.concatenate((docs, most)))]
        return pa.table([*columns, pa.array(flag)], names=_NAMES)

    return run


_NAMES = ["doc_id", "start", "stop", "n_words", "first_doc_id", "n_docs", "removed"]


def _by_text(passages: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Units come in order of row. Whole texts of some `UNITS` units are held at a time; a text of more stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, UNITS
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < most:
                continue
            units = pa.Table.from_batches(held)
            row = units.column("row").to_numpy()
            cut = int(np.searchsorted(row, row[-1]))
            if cut:
                yield from passages(units.slice(0, cut)).to_batches()
            held, n = units.slice(cut).to_batches(), n - cut
            most = max(UNITS, 2 * n)
        if n:
            yield from passages(pa.Table.from_batches(held)).to_batches()

    return run


def repeated_passages(documents: DataFrame, like: Likeness = Likeness(), least_words: int = LEAST_WORDS, recall: float = RECALL) -> DataFrame:
    """One row per repeated passage of a document: (doc_id, start, stop, n_words, first_doc_id, n_docs, removed).

    start and stop are code points of the text. Neighbouring paragraphs and windows of words, of `least_words` words together, that
    each occur in several documents are a run; a passage is a part of a run that is kept (removed is false) or removed as a whole.
    Words that no earlier document has are kept, the others removed; `first_doc_id` is the smallest document of any paragraph or
    window of the passage, and n_docs the most texts that have one of them (a text counts once for each of its near copies).
    Null and empty texts have none, nor has an empty table. Rows repeated under one id are one document: they repeat nothing
    by themselves, and each has its own rows. Rows without id are one document that comes after all others.
    Columns but doc_id and text are not read.
    """
    work = Workspace(documents.sparkSession, "substrings")
    bands, rows = tune(like.part / like.whole, recall)
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(1, n_bytes / 6 / BUCKET_WORDS))
    many = int(max(1, n_bytes / 6 / 20 * bands / BUCKET))
    shared = _banded(documents, bands, rows, many).repartition(many, "bucket").groupBy("bucket").applyInArrow(shared_of, SHARED)
    shared = work.keep(shared.withColumns({"kind": F.lit(0), "weight": F.lit(LONG).cast("long")}), "shared")
    found = connect(shared, lambda wanted, bits: _sets_of(documents, wanted, bits), like, work)
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    linked = work.keep(found.unionByName(roots).select(F.col("id").alias("key"), F.col("component").alias("cluster")), "linked")

    k, among = reach(least_words)
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    keys = _summed(_keys_of(texts, k, among)).join(linked, "key", "left").where("low <> high or cluster is not null")
    keys = work.keep(keys, "keys")
    odd = F.col("key").bitwiseAND(1) == 1
    # a window is an anchor by what stands around it, so what has it is counted anew
    repeated = keys.where(odd).select("key")
    wanted = repeated.unionAll(work.keep(_ends_of(texts, Bloom.of(repeated, repeated.count()), k, among), "ends"))
    exact = _summed(_chosen_windows(texts, Bloom.of(wanted, wanted.count()), k)).where("low <> high")

    near = keys.where(~odd).withColumn("cluster", F.coalesce("cluster", "key"))
    clusters = near.groupBy("cluster").agg(F.min("low").alias("first_doc_id"), F.max("high").alias("high"), F.sum("n").alias("n_docs")).where("first_doc_id <> high").drop("high")
    near = near.select("key", "cluster").join(work.keep(clusters, "clusters"), "cluster").drop("cluster")
    units = work.keep(near.unionByName(exact.select("key", F.col("low").alias("first_doc_id"), F.col("n").alias("n_docs"))), "units")
    places = _places_of(texts, Bloom.of(units.select("key"), units.count()), k).join(units, "key").drop("key")
    # copies have a place for nearly every word, so partitions are read in order and no more than some texts are held
    places = places.repartition(buckets, "row").sortWithinPartitions("row")
    return places.mapInArrow(_by_text(_passages(least_words)), "doc_id long, start long, stop long, n_words long, first_doc_id long, n_docs long, removed boolean")



def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
