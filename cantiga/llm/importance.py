"""Quality classifier by importance resampling.

Two generative models over hashed word and byte n-grams are counted: one of all documents (the raw text), and one of good text
(the target), from the documents labelled good. A document's log weight is the log ratio of its likelihoods under the two; a
Gumbel number drawn from a hash of its id is added, and the k documents of largest sum are an importance sample without
replacement. k is a share of the documents: by default the share of good ones among the labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .columns import U, buffers, key, mix, pieces, words
from .ngrams import BUCKETS, grams, sums
from .runtime import Workspace, documents, filtered
from .stats import summed

#: Labelled documents that the target model and the share are taken from at most. Raw counts cover every document.
SAMPLE = 20_000
#: Weight of the labelled documents in the target model; the rest is the raw model, which knows n-grams that no label covers.
TRUST = 0.5
#: Bins of a step towards the k-th largest key.
BINS = 1024


def _count(b: pa.RecordBatch, into: np.ndarray) -> None:
    """Word and byte n-grams of all texts, and of those labelled good."""
    offsets, data = buffers(b.column("text"))
    good = b.column("label").fill_null(0).to_numpy(zero_copy_only=False) > 0
    parts = into.reshape(2, 2, BUCKETS)
    for lo, hi in pieces(offsets):
        o, d = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        g, some = grams(o, d, words(o, d)), good[lo:hi]
        parts[0, 0] += np.bincount(g.word, minlength=BUCKETS)
        parts[0, 1] += np.bincount(g.byte, minlength=BUCKETS)
        if some.any():
            parts[1, 0] += np.bincount(g.word[some[g.word_row]], minlength=BUCKETS)
            parts[1, 1] += np.bincount(g.byte[np.repeat(some, np.diff(g.byte_row_bounds))], minlength=BUCKETS)


def log_ratios(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word bucket and per byte bucket: log of target over raw probability.

    The raw model counts one n-gram more in each bucket. The target model is a mixture of the labelled documents' shares and the raw
    model (Jelinek-Mercer smoothing). Without good documents both are the same.
    """
    out = []
    for raw, good in zip(*counts.reshape(2, 2, BUCKETS), strict=True):
        raw = (raw + 1) / (raw + 1).sum()
        target = TRUST * good / good.sum() + (1 - TRUST) * raw if good.any() else raw
        out.append(np.log(target / raw))
    return out[0], out[1]


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """A standard Gumbel number from each id, the same on each run."""
    u = (mix(ids.astype(np.int64).view(U) ^ key(seed, 7)) >> U(11)).astype(np.float64) / (1 << 53)
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


class Model(NamedTuple):
    word: np.ndarray  #: log ratio of each bucket
    byte: np.ndarray
    share: float  #: of the documents that are taken
    seed: int

    def weigh(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and key of each row."""
        offsets, data = buffers(b.column("text"))
        out = [np.zeros(0)]
        for lo, hi in pieces(offsets):
            o, d = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
            of_words, _, of_bytes, _ = sums(grams(o, d, words(o, d)), self.word, self.byte, hi - lo)
            out.append(of_words + of_bytes)
        weight = np.concatenate(out)
        return weight, weight + gumbel(b.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(), self.seed)


def fit(documents: DataFrame, labels: DataFrame, share: float | None = None, rows: int = SAMPLE, seed: int = 0) -> Model:
    """Counts both models. share: of the documents to take; by default that of good ones among the labelled, 1 without good ones."""
    few = F.broadcast(labelled.sample(labels, rows))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    word, byte = log_ratios(summed(docs.join(few, "doc_id", "left"), ["text", "label"], _count, 4 * BUCKETS))
    if share is None:
        good, seen = few.agg(F.count_if(F.col("label") > 0), F.count("*")).first()
        share = good / seen if good else 1.0
    return Model(word, byte, share, seed)


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of a column of numbers, exactly: the bin that holds it is split until its rows are equal.

    Each step sends a count, the least and the largest of each bin to the driver. inf for k = 0, -inf if there are no more than k.
    """
    x = F.col(values.columns[0])
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if k <= 0:
        return np.inf
    if k >= n:
        return -np.inf
    while low < high:
        bin_of = F.least(F.lit(BINS - 1), F.floor((x - low) / (high - low) * BINS))
        bins = values.where((x >= low) & (x <= high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for b in sorted(bins.collect(), key=lambda r: -r.bin):
            if k <= b.n:
                low, high = b.low, b.high
                break
            k -= b.n
    return float(low)


def weighted(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, log_weight, key)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, keys = sent.value.weigh(b)
            yield pa.record_batch([b.column("doc_id"), pa.array(weight), pa.array(keys)], names=["doc_id", "log_weight", "key"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, log_weight double, key double")


def _top(documents: DataFrame, model: Model, work: Workspace) -> tuple[DataFrame, float]:
    """All documents' weights, and the k-th largest key."""
    rows = work.keep(weighted(documents, model), "weights")
    return rows, kth_largest(rows.select("key"), round(model.share * rows.count()))


def resample(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, log_weight, key, kept): the Gumbel top-k of the documents.

    A null or empty text has weight 0 and its Gumbel number; repeated ids, and rows without id, have equal numbers and stay or go by
    their texts; rows of equal keys stay or go together. Without good labels all documents stay. Columns but
    doc_id and text are not read. An empty table gives no rows.
    """
    rows, cut = _top(documents, model, Workspace(documents.sparkSession, "importance"))
    return rows.withColumn("kept", F.col("key") >= cut)


def kept_rows(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents`, all columns, that `resample` keeps."""
    work = Workspace(documents.sparkSession, "importance")
    _, cut = _top(documents, model, work)
    work.close()
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return filtered(documents, lambda b: sent.value.weigh(b)[1] >= cut)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return resample(docs, fit(docs, labelled.labels(spark, sf_dir)))
