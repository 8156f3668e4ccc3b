"""Quality rules: fixed text statistics, and a logistic regression on hashed word and byte n-grams with a calibrated probability.

The model is fitted on the driver from at most `SAMPLE` labelled documents (the features of these, not their texts, reach it).
Scoring is one pass over the documents without a shuffle: the weights (two vectors of fixed length) go to the executors,
and each Arrow batch is cut into pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .columns import Index, U, buffers, is_space, long_array, pieces, prefix_sums, sets, span_hashes, total, windows, words
from .ngrams import BUCKETS, grams, sums
from .runtime import documents

#: Labelled documents that the model is fitted on at most; a quarter of them only calibrates.
SAMPLE = 2000
#: A document is kept from this probability of good quality on.
KEEP_FROM = 0.5
SYMBOLS = b"#*$%&|<>"


class Model(NamedTuple):
    word: np.ndarray
    byte: np.ndarray
    bias: float
    slope: float  #: of the calibration
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


#: Where labels of both kinds are lacking nothing can be learnt, and nothing is rejected.
NEUTRAL = Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, 50.0)


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE, steps: int = 120) -> Model:
    """Trains on the labelled documents of `labels` (doc_id, quality) that the sample of `rows` holds."""
    few = labelled.sample(labels, rows)
    had = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").mapInArrow(_features, "doc_id long, label int, buckets binary, shares binary").collect()
    had = sorted({r.doc_id: r for r in had}.values(), key=lambda r: r.doc_id)
    y = np.array([r.label for r in had], np.float64)
    if len(set(y)) < 2:
        return NEUTRAL
    cut = np.arange(len(had)) % 4 == 3
    x = [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.shares, np.float32)) for r in had]
    if len(set(y[cut])) < 2 or len(set(y[~cut])) < 2:
        cut[:] = False
    w, bias = _regress([v for v, c in zip(x, cut) if not c], y[~cut], steps)
    score = np.array([bias + (w[i] * v).sum() for i, v in x])
    slope, shift = _calibrate(score[cut], y[cut]) if cut.any() else (1.0, 0.0)
    return Model(w[:BUCKETS].astype(np.float32), w[BUCKETS:].astype(np.float32), float(bias), slope, shift)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, data = buffers(b.column("text"))
        out = []
        for lo, hi in pieces(offsets, rows=1):
            o, d = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
            g = grams(o, d, words(o, d, fold=False))
            n = np.concatenate((np.bincount(g.word, minlength=BUCKETS) / max(1, len(g.word)), np.bincount(g.byte, minlength=BUCKETS) / max(1, len(g.byte))))
            at = np.flatnonzero(n)
            out.append((at.astype(np.int32).tobytes(), n[at].astype(np.float32).tobytes()))
        yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("label"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["doc_id", "label", "buckets", "shares"])


def _regress(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch AdaGrad on the log loss, classes weighed alike."""
    at, value = np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x]).astype(np.float64)
    row = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, bias, seen, seen_bias = np.zeros(2 * BUCKETS), 0.0, np.full(2 * BUCKETS, 1e-12), 1e-12
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[at], len(x)) + bias, -50, 50)))
        g = (p - y) * weight
        step = np.bincount(at, value * g[row], 2 * BUCKETS) + 1e-9 * w
        seen += step * step
        w -= 2.0 * step / np.sqrt(seen)
        seen_bias += g.sum() ** 2
        bias -= 0.2 * g.sum() / np.sqrt(seen_bias)
    return w, bias


def _calibrate(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic calibration on rows that the weights have not seen: Newton steps on smoothed targets."""
    good, bad = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(1e-9, float(np.abs(score).mean()))
    x = np.stack((score / scale, np.ones_like(score)), 1)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, x.T @ (p - t)), -5, 5)
    return float(max(b[0], 0) / scale), float(b[1])


def _statistics(offsets: np.ndarray, data: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    w = words(offsets, data, fold=False)
    lead = (data & 0xC0) != 0x80
    n_words = np.diff(w.bounds)
    symbol = np.zeros(len(data), bool)
    for c in SYMBOLS:
        symbol |= data == c
    where = np.flatnonzero(symbol)

    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((offsets[:-1], cut + 1)))
    begin = begin[begin < len(data)]
    end = np.minimum(np.append(begin[1:], len(data)), len(data))
    row = np.searchsorted(offsets, begin, "right") - 1
    end = np.where(data[end - 1] == 10, end - 1, end) if len(end) else end
    some = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end, row = begin[some], end[some], row[some]
    lines = sets(span_hashes(prefix_sums(data), begin, end), row, rows)

    h, at = windows(w.hashes, w.bounds, 3, short=False)
    at_row = np.searchsorted(w.bounds, at, "right") - 1
    full = (at_row.astype(U) << U(48)) | (h >> U(16))
    order = np.sort(full)
    twice = order[1:][order[1:] == order[:-1]]
    covered = np.zeros(len(w.hashes), bool)
    if len(twice):
        first = at[Index(np.unique(twice)).find(full) >= 0]
        for j in range(3):
            covered[first + j] = True

    word_sum, word_n, byte_sum, byte_n = sums(grams(offsets, data, w), model.word, model.byte, rows)
    score = model.bias + word_sum / np.maximum(1, word_n) + byte_sum / np.maximum(1, byte_n)
    return {
        "n_words": n_words,
        "word_chars": total((lead & ~is_space(data)).astype(np.int64), offsets),
        "n_symbols": np.diff(np.searchsorted(where, offsets)),
        "n_dup_lines": np.bincount(row, minlength=rows) - np.diff(lines.bounds),
        "n_repeat_words": total(covered.astype(np.int64), w.bounds),
        "probability": model.probability(score),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def apply_rules(documents: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: its statistics, whether the fixed rules reject it, and whether it is kept.

    A null text is empty; a document without words fails the fixed rules. Repeated rows and ties each get a row of their own;
    an empty table gives none. Other columns are not read, whatever their names.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            offsets, data = buffers(b.column("text"))
            ids = b.column("doc_id").cast(pa.int64())
            got = [_statistics(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], model) for lo, hi in pieces(offsets)]
            if not got:
                continue
            s = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            kept = ~failed & (s["probability"] >= keep_from)
            yield pa.record_batch([ids, *(long_array(s[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(s["probability"])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(score, SCHEMA)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return apply_rules(docs, fit(docs, labelled.labels(spark, sf_dir)))
