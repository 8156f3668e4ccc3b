"""Mixing sources to target weights by the cube method.

Each source's target over its size gives every one of its documents the same expected number of copies: a whole part that all
get, and a fractional inclusion probability. The flight phase moves the probabilities of three documents at a time along the
null space of the constraints (documents, words) until they are 0 or 1, so a source's document and word totals stay as
expected. It runs in blocks of bounded size, however large a source is; each block leaves two documents at most, and these
fly on together in the next level's blocks, until a source has one block, whose last two documents are landed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import U, buffers, is_space, key, mix, pieces
from .runtime import Workspace, documents

#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often.
MOST = 3
#: Documents that fly together.
BLOCK = 2_000


def word_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words of each text, 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers(b.column("text"))
            size = [_counts(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]) for lo, hi in pieces(offsets)]
            yield pa.record_batch([b.column("doc_id"), b.column("source"), pa.array(np.concatenate(size) if size else [], pa.int64())], names=["doc_id", "source", "size"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, "doc_id long, source string, size long")


def _counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    begin = ~is_space(data)
    inside = begin.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begin[cuts] = inside[cuts]
    return np.diff(np.searchsorted(np.flatnonzero(begin), offsets))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: (source, docs, source_size, target).

    Targets are min(most * size, level * weight) with the one level that shares out all words: the sources that stop at their
    limit are those of the smallest limit for their weight, so it is read off a running sum.
    """
    each = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    limit = F.col("source_size") * most
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    full = F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1))
    heavier = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) - F.coalesce(full, F.lit(0))) / heavier
    # at the first source whose limit is above the level that is left for it and all after it, that level is the one
    each = each.withColumn("limit", limit.cast("double")).withColumn("level", level)
    found = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(whole)
    return each.select("source", "docs", "source_size", F.least("limit", found["level"] * F.col("weight")).alias("target"))


def fly(size: np.ndarray, p: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The flight phase: all but two probabilities at most become 0 or 1, sums of p and of p * size stay."""
    p, n = p.astype(float).tolist(), len(p)
    x = size.tolist()
    draw = (mix(np.arange(n, dtype=U) ^ seed) >> U(11)).astype(np.float64) / (1 << 53)
    draw = draw.tolist()
    active: list[int] = []
    for i in range(n):
        if not 0 < p[i] < 1:
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if not any(u):
                u = (1, -1, 0)
            up = down = float("inf")
            for k, v in zip(active, u, strict=True):
                if v:
                    rise, fall = ((1 - p[k]) / v, p[k] / v) if v > 0 else (p[k] / -v, (1 - p[k]) / -v)
                    up, down = min(up, rise), min(down, fall)
            step = up if draw[i] * (up + down) < down else -down
            draw[i] = draw[i] * 7919 % 1
            for k, v in zip(active, u, strict=True):
                q = p[k] + step * v
                p[k] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
            active = [k for k in active if 0 < p[k] < 1]
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Gives the few probabilities left 0 or 1. While words are then missing, or too many, the document whose size is nearest to them changes sides."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    words, best = float((p * size).sum()), None
    for outcome in product((0.0, 1.0), repeat=len(left)):
        q = p.copy()
        q[left] = outcome
        gap = words - float((q * size).sum())
        while True:
            change = np.where(q > 0, -size, size)
            k = int(np.argmin(np.abs(gap - change)))
            if abs(gap - change[k]) >= abs(gap):
                break
            q[k], gap = 1 - q[k], gap - change[k]
        if best is None or abs(gap) < best[0]:
            best = abs(gap), q
    return best[1]


def _flight(last: bool, seed: int):
    def run(block: pa.Table) -> pa.Table:
        ids = block.column("doc_id").fill_null(-1).to_numpy()
        size, p = block.column("size").to_numpy(), block.column("p").to_numpy()
        order = np.lexsort((p, size, ids, mix(ids.astype(np.int64).view(U) ^ key(seed, 1))))
        block = block.take(pa.array(order))
        p = fly(size[order], p[order], mix(np.array([np.bitwise_xor.reduce(mix(ids.view(U)))], U) ^ key(seed, 2))[0])
        if last:
            p = land(size[order], p)
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p))

    return run


def mix_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) of each row of `sized` (doc_id, source, size).

    A row is taken `copies` times: the whole part of its source's target / size, or one more, and never more than `most`.
    Null sources are one source, last in order; rows of size 0 take no words and fly like others; repeated rows are documents
    of their own; an empty table gives no rows. The same rows give the same result.
    """
    work = Workspace(sized.sparkSession, "mixing")
    sized = work.keep(sized, "sized")
    goals = work.keep(targets(sized, weights, most), "targets")
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = sized.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("share", share)
    rows = rows.withColumn("base", F.floor("share")).withColumn("p", F.col("share") - F.col("base")).withColumn("waits", F.col("docs")).drop("share", "docs")
    schema, settled, level = rows.withColumn("block", F.lit(0)).schema, [], 0
    while True:
        blocks = F.ceil(F.col("waits") / block).cast("int")
        rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size"), F.greatest(blocks, F.lit(1))).cast("int"))
        # a source of one block lands there; the others go on with what their blocks leave
        whole = work.keep(rows.where(f"waits <= {block}").groupBy("source", "block").applyInArrow(_flight(True, seed + level), schema), f"landed{level}")
        flown = work.keep(rows.where(f"waits > {block}").groupBy("source", "block").applyInArrow(_flight(False, seed + level), schema), f"flown{level}")
        settled += [whole, flown.where("p = 0 or p = 1")]
        rows = flown.where("p > 0 and p < 1")
        if rows.isEmpty():
            break
        left = rows.groupBy("source").agg(F.count("*").alias("waits"))
        rows = rows.drop("waits", "block").join(left.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").select(*[c for c in schema.names if c != "block"])
        level += 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.withColumn("copies", (F.col("base") + F.round("p")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(word_counts(documents(spark, sf_dir)))
