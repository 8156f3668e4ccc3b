"""Hidden Markov language model of word sequences.

Words are counted over all training documents. The most frequent `SYMBOLS` of them are symbols of the model; all others are one
further symbol, which emits a word in proportion to its smoothed count, so every word has a probability and they add up to one.
Every pass of Baum-Welch takes its expected counts from all training documents, added up across
partitions; nothing but the counts, of fixed size, reaches the driver. Scores are exact: a scaled forward recursion over the
whole text, many texts side by side.

Counts of frequent words (`HEAD`, a fixed number) travel to the executors; those of other words, of which there are more the
larger the corpus, are joined by word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import Index, U, buffers, key, long_array, mix, pieces, signed, words
from .runtime import Workspace, documents
from .stats import summed

#: Hidden states; symbols; words whose counts are sent to every executor.
STATES, SYMBOLS, HEAD = 8, 1 << 14, 1 << 17
#: Passes over all training documents, at most, and the gain of log10 likelihood a token below which they end.
PASSES, GAIN = 14, 1e-4
END = key(41)
#: Tokens that are run side by side; a longer text stands alone.
TOKENS = 1 << 19
#: Tokens of training texts that are put in order of length together, and those of a group that is run side by side.
HELD, GROUP = 1 << 23, 1 << 19
#: Tokens of a block of steps, and the steps after which rows are scaled: in 8 of them doubles lose nothing, whatever a step takes away.
STEPS, RESCALE = 1 << 12, 8
#: Tokens whose posteriors are added up together.
POSTERIORS = 1 << 16


def training(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) != 1


class Tokens(NamedTuple):
    hashes: np.ndarray
    bounds: np.ndarray


def tokens(offsets: np.ndarray, data: np.ndarray) -> Tokens:
    """The words of each text and then one end."""
    w = words(offsets, data)
    n = np.diff(w.bounds)
    bounds = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(bounds[-1], END, U)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    out[inner] = w.hashes
    return Tokens(out, bounds)


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[int, int, Tokens]]:
    offsets, data = buffers(b.column("text"))
    for lo, hi in pieces(offsets):
        yield lo, hi, tokens(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])


def _groups(b: pa.RecordBatch) -> Iterator[tuple[int, int, Tokens]]:
    """Row ranges of some `TOKENS` tokens."""
    held: list[Tokens] = []
    first = 0
    for lo, hi, t in _chunks(b):
        if held and sum(len(h.hashes) for h in held) + len(t.hashes) > TOKENS:
            yield first, lo, _join(held)
            held, first = [], lo
        held.append(t)
    if held:
        yield first, len(b), _join(held)


def _join(held: list[Tokens]) -> Tokens:
    steps = np.cumsum([0] + [len(t.hashes) for t in held])
    return Tokens(np.concatenate([t.hashes for t in held]), np.concatenate([held[0].bounds[:1], *(t.bounds[1:] + s for t, s in zip(held, steps[:-1], strict=True))]))


def counted(texts: DataFrame) -> DataFrame:
    """(word, count): how often each token occurs. Words are known by 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, t in _groups(b):
                word, count = np.unique(t.hashes, return_counts=True)
                yield pa.record_batch([long_array(word), long_array(count)], names=["word", "count"])

    return texts.select("text").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts, the most frequent first: all words from some count on, so many that `most` is not passed.

    The count is read off a histogram of count classes, so the driver never gets more than `most` rows.
    """
    kind = F.floor(F.log2("count") * 32).cast("int")
    classes = sorted(((r.k, r.n) for r in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in classes:
        total += n
        if total > most:
            break
        least = k
    rows = counts.where(kind >= least).collect() if least is not None else []
    rows.sort(key=lambda r: (-r["count"], r.word))
    return np.array([r.word for r in rows], np.int64).view(U), np.array([r["count"] for r in rows], np.float64)


@lru_cache(1)
def one_thread() -> None:
    """Tasks have a core each: further threads of OpenBLAS would only wait in loops, which doubles the CPU seconds."""
    maps = Path("/proc/self/maps")
    for path in {line.split()[-1] for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else ():
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


class Model(NamedTuple):
    start: np.ndarray  #: states
    move: np.ndarray  #: states x states
    emit: np.ndarray  #: symbols + 1 x states; the last symbol is every other word

    @property
    def size(self) -> int:
        return self.start.size + self.move.size + self.emit.size + 1


def _order(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens, step by step and at each step from the longest text on, and how many texts have a token at each step."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    live = np.searchsorted(-n[order], -np.arange(n.max() if len(n) else 0), "left")
    start = np.cumsum(live) - live
    step = np.repeat(np.arange(len(live)), live)
    return bounds[:-1][order[np.arange(len(step)) - start[step]]] + step, live


def forward(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The log10 likelihood of each text."""
    place, live = _order(bounds)
    emit, kind = model.emit[symbols[place]], model.emit.dtype
    scale, one = np.ones(len(symbols), kind), np.ones(len(model.start), kind)
    a, z = None, 0
    for t, n in enumerate(live.tolist()):
        now, z = slice(z, z + n), z + n
        a = (model.start if t == 0 else a[:n] @ model.move) * emit[now]
        s = a @ one
        scale[now] = s
        a = np.divide(a, s[:, None], out=emit[now])
    log = np.zeros(len(symbols) + 1)
    log[1 + place] = np.log10(scale)
    log = np.cumsum(log)
    return log[bounds[1:]] - log[bounds[:-1]]


_buffers: dict[str, np.ndarray] = {}


def _buffer(name: str, *shape: int) -> np.ndarray:
    """Memory that a worker keeps, as fresh pages cost more than what is done with them."""
    size = int(np.prod(shape))
    if name not in _buffers or len(_buffers[name]) < size:
        _buffers[name] = np.empty(size)
    return _buffers[name][:size].reshape(shape)


def expect(model: Model, symbols: np.ndarray, bounds: np.ndarray, into: np.ndarray) -> None:
    """Adds the expected counts of starts, moves and emissions, and the log10 likelihood, to a vector.

    Steps go in blocks that stay in a core's cache; of all tokens only forward rows are held. Rows are scaled every
    `RESCALE` steps: each token's posterior is scaled by its own sum, so no other scale is needed.
    """
    total, k, width = len(symbols), len(model.start), len(model.emit)
    if not total:
        return
    place, live = _order(bounds)
    symbols = symbols[place].astype(np.intp)
    one, square, back = np.ones(k), np.ones((k, k)), np.ascontiguousarray(model.move.T)
    # emissions as shares of a symbol, so what a step takes away is small
    top = model.emit @ one
    top[top == 0] = 1
    emit = model.emit / top[:, None]
    first = np.concatenate(([0], np.cumsum(live)))
    before = np.arange(total) - np.repeat(np.append(0, live[:-1]), live)
    cuts = [0]
    while cuts[-1] < len(live):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + STEPS, "right")) - 1))
    blocks = list(zip(cuts[:-1], cuts[1:], first[cuts[:-1]].tolist(), first[cuts[1:]].tolist(), strict=True))
    most = max(hi - lo for *_, lo, hi in blocks)
    rows, post = _buffer("rows", total, k), _buffer("post", k, max(most, POSTERIORS))
    ahead_of, gamma_of, part_of = (_buffer(x, most, k) for x in ("ahead", "gamma", "part"))
    live, log, a = live.tolist(), 0.0, None
    for begin, end, lo, hi in blocks:
        ahead, z = ahead_of[: hi - lo], lo
        emit.take(symbols[lo:hi], 0, ahead, "clip")
        for t in range(begin, end):
            n = live[t]
            now = rows[z : z + n]
            if t:
                np.dot(a[:n], model.move, now)
                np.multiply(now, ahead[z - lo : z - lo + n], now)
            else:
                np.multiply(model.start, ahead[:n], now)
            if t % RESCALE == 0:
                s = np.dot(now, one)
                log += np.log10(s).sum()
                now /= s[:, None]
            a, z = now, z + n
    ended = np.array(live) - np.append(live[1:], 0)
    last = np.repeat(first[1:] - np.cumsum(ended), ended) + np.arange(live[0])
    log += np.log10(rows[last] @ one).sum()

    tokens, emits = np.zeros(width), into[k + k * k : -1].reshape(width, k)

    def emitted(lo: int, hi: int) -> None:
        for j in range(k):
            column = np.bincount(symbols[lo:hi], post[j, post.shape[1] - (hi - lo) :], width)
            emits[:, j] += column
            tokens[:] += column

    moves, later, more, until = np.zeros((k, k)), None, 0, total
    for begin, end, lo, hi in reversed(blocks):
        ahead, gamma, part, z = ahead_of[: hi - lo], gamma_of[: hi - lo], part_of[: hi - lo], hi - lo
        emit.take(symbols[lo:hi], 0, ahead, "clip")  # emission times backward row
        for t in range(end - 1, begin - 1, -1):
            n = live[t]
            now, z = ahead[z - n : z], z - n
            if more:
                np.multiply(now[:more], np.dot(later, back), now[:more])
            if t % RESCALE == 0:
                now /= np.dot(now, one)[:, None]
            later, more = now, n
        later = later.copy()
        # a token's posterior is its predicted row times what is ahead of it
        rows.take(before[lo:hi], 0, gamma, "clip")
        np.dot(gamma, model.move, part)
        if not begin:
            part[: live[0]], gamma[: live[0]] = model.start, 0
        part *= ahead
        s = np.dot(part, square)
        np.reciprocal(s, s)
        part *= s
        ahead *= s
        moves += np.dot(gamma.T, ahead)
        if until - lo > post.shape[1]:
            emitted(hi, until)
            until = hi
        post[:, post.shape[1] - (until - lo) : post.shape[1] - (until - hi)] = part.T
        if not begin:
            into[:k] += part[: live[0]].sum(0)
    into[k : k + k * k] += (model.move * moves).ravel()
    emitted(0, until)
    into[-1] += log + tokens @ np.log10(top)


def improved(model: Model, counts: np.ndarray) -> Model:
    """The model of largest likelihood under expected counts, smoothed by a little of the overall shares."""
    k, width = len(model.start), len(model.emit)
    start, move = counts[:k], counts[k : k + k * k].reshape(k, k)
    emit = counts[k + k * k : -1].reshape(width, k)
    share = emit.sum(1) + 0.5
    share /= share.sum()
    emit = emit + 20.0 * share[:, None]
    return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def initial(shares: np.ndarray, states: int = STATES) -> Model:
    """Symbol shares, tilted differently for each state by hashes; states prefer to stay."""
    tilt = (mix(np.arange(len(shares) * states, dtype=U) ^ key(42)) >> U(11)).astype(np.float64).reshape(-1, states) / (1 << 53)
    emit = shares[:, None] * np.exp(2 * tilt)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def alike(symbols: list[np.ndarray], lengths: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and lengths of some `GROUP` tokens at a time, the longest texts first, as a group takes as many steps as its longest."""
    symbols, lengths = np.concatenate(symbols), np.concatenate(lengths)
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    group = (np.cumsum(lengths) - lengths) // GROUP
    for at in np.split(np.arange(len(order)), np.flatnonzero(np.diff(group)) + 1):
        n = lengths[at]
        yield symbols[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def coded(texts: DataFrame, symbol_words: np.ndarray) -> DataFrame:
    """(symbols, lengths): all texts as symbols, and the number of tokens of each, many texts of like length a row."""
    sent = texts.sparkSession.sparkContext.broadcast(symbol_words)

    def rows(symbols: list[np.ndarray], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s, n in alike(symbols, lengths):
            yield pa.record_batch([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (s, n)], names=["symbols", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        index = _index(known)
        symbols: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        for b in batches:
            for _, _, t in _groups(b):
                symbols.append(_symbols(index, t.hashes, len(known)).astype(np.int32))
                lengths.append(np.diff(t.bounds))
                if sum(map(len, symbols)) > HELD:
                    yield from rows(symbols, lengths)
                    symbols, lengths = [], []
        if symbols:
            yield from rows(symbols, lengths)

    return texts.select("text").mapInArrow(run, "symbols binary, lengths binary")


def train(texts: DataFrame, symbol_words: np.ndarray, shares: np.ndarray, states: int = STATES, passes: int = PASSES, gain: float = GAIN) -> Model:
    """Passes over all texts on the executors, from symbol shares tilted by hashes on, until they gain little.

    Words are looked up once: what passes read are the texts as symbols.
    """
    work = Workspace(texts.sparkSession, "hmm-train")
    groups = work.keep(coded(texts, symbol_words), "coded")
    model, before = initial(shares, states), -np.inf
    for _ in range(passes):
        sent = texts.sparkSession.sparkContext.broadcast(model)

        def count(b: pa.RecordBatch, into: np.ndarray, sent=sent) -> None:
            one_thread()
            for symbols, lengths in zip(b.column("symbols"), b.column("lengths"), strict=True):
                bounds = np.concatenate(([0], np.cumsum(np.frombuffer(lengths.as_buffer(), "<i4"), dtype=np.int64)))
                expect(sent.value, np.frombuffer(symbols.as_buffer(), "<i4"), bounds, into)

        counts = summed(groups, ["symbols", "lengths"], count, model.size)
        sent.unpersist()
        model = improved(model, counts)
        # each token is emitted once
        k, now = states, counts[-1]
        n = counts[k + k * k : -1].sum()
        if now - before <= gain * n:
            break
        before = now
    work.close()
    return model


_kept: dict[tuple, Index] = {}


def _index(known: np.ndarray) -> Index:
    """One index for all batches of a worker."""
    name = (len(known), int(known[:1].sum()), int(np.bitwise_xor.reduce(known)) if len(known) else 0)
    if name not in _kept:
        _kept.clear()
        _kept[name] = Index(known)
    return _kept[name]


def _symbols(index: Index, hashes: np.ndarray, width: int) -> np.ndarray:
    at = index.find(hashes)
    return np.where((at >= 0) & (at < width), at, width)


SCORED = "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<long>"


def score_documents(documents: DataFrame, states: int = STATES, symbols: int = SYMBOLS, head: int = HEAD) -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    A null or empty text is the end token alone. Repeated rows are scored each, and train each. Without training documents every
    token is unknown and shares what is left. An empty table gives no rows. Columns but doc_id and text are not read.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "hmm")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", ~F.coalesce(training(), F.lit(True)))
    texts = docs.where("not held_out")
    counts = work.keep(counted(texts), "counts")
    n, v = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    known, known_count = most_frequent(counts, head)
    symbol_words = np.ascontiguousarray(known[:symbols])
    # the last symbol's words: smoothed counts of all words that are no symbols, and of the unknown
    other = float(n + 0.5 * (v + 1) - (known_count[: len(symbol_words)] + 0.5).sum())
    shares = np.append(known_count[: len(symbol_words)] + 0.5, other)
    model = train(texts, symbol_words, shares / shares.sum(), states)
    sent = spark.sparkContext.broadcast((model, known, known_count, len(symbol_words)))
    floor, log_other = float(np.log10(n + 0.5 * (v + 1))), float(np.log10(other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        _buffers.clear()
        model, known, count, width = sent.value
        index = _index(known)
        worth = np.append(np.log10(count + 0.5), 0.0)
        for b in batches:
            for lo, hi, t in _groups(b):
                at = index.find(t.hashes).astype(np.int64)
                sums = np.concatenate(([0.0], np.cumsum(worth[at])))
                n_tokens = np.diff(t.bounds)
                rest = np.concatenate(([0], np.cumsum(at < 0)))[t.bounds].astype(np.int32)
                base = sums[t.bounds[1:]] - sums[t.bounds[:-1]]
                score = forward(model, np.where((at >= 0) & (at < width), at, width), t.bounds)
                # other words that the head knows: their part of the last symbol
                part = np.concatenate(([0.0], np.cumsum(np.where(at >= width, worth[at], 0.0))))
                last = np.concatenate(([0], np.cumsum((at < 0) | (at >= width))))
                score = score + part[t.bounds[1:]] - part[t.bounds[:-1]] - log_other * (last[t.bounds[1:]] - last[t.bounds[:-1]])
                words = pa.ListArray.from_arrays(pa.array(rest), long_array(t.hashes[at < 0]))
                s = b.slice(lo, hi - lo)
                yield pa.record_batch([s.column("doc_id"), s.column("row"), s.column("held_out"), long_array(n_tokens), long_array(n_tokens - np.diff(rest)), pa.array(base - floor * n_tokens), pa.array(score), words], names=[x.split()[0] for x in SCORED.split(", ")])

    scored = work.keep(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, SCORED), "scored")
    tail = scored.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    tail = tail.join(counts, "word", "left").withColumn("part", F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + 0.5))
    tail = tail.groupBy("row").agg(F.sum("part").alias("part"), F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("more"))
    out = scored.drop("rest").join(tail, "row", "left")
    part = F.coalesce("part", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + part).alias("base_score"), (F.col("score") + part).alias("score"))


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
