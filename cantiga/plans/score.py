"""Predicted lines scored against reference lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import block_alignment, containments
from ..operators.scoring import tolerance_shares, upper_median

REFERENCE, PREDICTED = 0, 1
_SCORES = pa.schema([("song_id", pa.int64()), *((c, pa.int64()) for c in ("gt", "pred", "ok", "part", "miss")), ("acc", pa.float64()), ("resid", pa.list_(pa.float64()))])


def _scored(song: int | None, a: list[list[str]], gt: list[float], b: list[list[str]], pt: list[float]) -> tuple | None:
    shares = containments(a, b)
    found = block_alignment(a, b, shares) if a and b else None
    if found is None:
        return None
    owner, first = found
    held = [shares[k, o] if o is not None else 0.0 for k, o in enumerate(owner)]
    ok, part = sum(c >= 0.80 for c in held), sum(0.50 <= c < 0.80 for c in held)
    resid = [pt[j] - gt[k] for j, k in enumerate(first) if k is not None and k < len(a) and b[j]]
    return song, len(a), len(b), ok, part, len(a) - ok - part, ok / len(a), resid


def _songs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of song, side and line. One song is held at a time."""

    def made(rows: list[tuple | None]) -> pa.RecordBatch:
        rows = [r for r in rows if r is not None]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SCORES), _SCORES, strict=True)], schema=_SCORES)

    now, sides, open_ = None, (([], []), ([], [])), False
    for batch in batches:
        out = []
        song, side, words = (batch.column(c).to_pylist() for c in ("song_id", "side", "words"))
        at = batch.column("t_s").to_numpy(zero_copy_only=False).astype(np.float64).tolist()
        for s, k, w, t in zip(song, side, words, at, strict=True):
            if open_ and s != now:
                out.append(_scored(now, *sides[0], *sides[1]))
                sides = (([], []), ([], []))
            now, open_ = s, True
            sides[k][0].append(w)
            sides[k][1].append(t)
        yield made(out)
    if open_:
        yield made([_scored(now, *sides[0], *sides[1])])


def score(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(song_id, gt, pred, ok, part, miss, acc, resid) of lines (song_id, i, t_s, words) and (song_id, j, t_s, words).

    Songs that lack either side, or cannot be aligned, have no row.
    """
    sides = [rows.select("song_id", F.lit(k).alias("side"), F.col(at).alias("at"), "t_s", "words") for k, rows, at in ((REFERENCE, reference, "i"), (PREDICTED, predicted, "j"))]
    return score_sides(sides[0].unionAll(sides[1]))


def score_sides(rows: DataFrame) -> DataFrame:
    """`score` of lines (song_id, side, at, t_s, words) of both sides, `at` being the place of a line on its side."""
    rows = rows.select(F.col("song_id").cast("long").alias("song_id"), "side", "at", F.col("t_s").cast("double").alias("t_s"), "words")
    rows = rows.repartition("song_id").sortWithinPartitions("song_id", "side", "at")
    return rows.mapInArrow(_songs, "song_id long, gt long, pred long, ok long, part long, miss long, acc double, resid array<double>")


def totals(scores: DataFrame) -> DataFrame:
    """One row per song and, of null song, the total; ratios are of sums. Songs are scored once: each is one row a residual, of which the first has the counts."""
    counts = ("gt", "pred", "ok", "part", "miss")
    each = scores.select("song_id", *counts, F.posexplode_outer("resid").alias("at", "r"))
    each = each.select("song_id", *(F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c) for c in counts), "r")
    out = each.rollup("song_id").agg(*(F.sum(c).alias(c) for c in counts), upper_median(F.col("r")).alias("median"), *(c.alias(n) for n, c in tolerance_shares(F.col("r")).items()))
    return out.select("song_id", *counts, (F.col("ok") / F.col("gt")).alias("acc"), "median", "acc_05", "acc_1", "acc_2")
