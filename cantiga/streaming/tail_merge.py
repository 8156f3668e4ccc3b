"""Line tails rejoined on a stream of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import HUMMING
from ..functions.text import normalize, weight

OUT = "song_id long, line_index int, start_ms double, end_ms double, confidence double, text string, align_text string"
STATE = "made int, start_ms double, end_ms double, confidence double, text string, align_text string, norm string, weight long"


def _is_tail(prev: str, cur: str, text: str) -> bool:
    n = len(text.replace("\t", " ").split())
    return n <= 2 and (n == 0 or not cur or f" {cur} " not in f" {prev} ")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = list(state.get) if state.exists else None
    out = []
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], *held[:6])], columns=[c.split()[0] for c in OUT.split(", ")])
        return
    rows = pd.concat(list(batches)).sort_values("line_index")
    for r in rows.itertuples():
        if held and r.text != HUMMING and held[5] != "" and _is_tail(held[6], r.norm, r.text):
            a, b = held[7], r.weight
            held = [held[0], held[1], r.end_ms, (held[3] * a + r.confidence * b) / max(1, a + b), f"{held[4]} {r.text}", f"{held[5]} {r.align_text}", f"{held[6]} {r.norm}".strip(), a + b]
            continue
        if held:
            out.append((key[0], *held[:6]))
        held = [held[0] + 1 if held else 0, r.start_ms, r.end_ms, r.confidence, r.text, r.align_text, r.norm, r.weight]
    state.update(tuple(held))
    state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 60_000)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def merge_split_lines(lines: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """The batch operator of this name on a stream (ts, song_id, line_index, start_ms, end_ms, confidence, text, align_text).

    Lines of a song arrive in order. A line is given once the next one cannot join it any more, or once the watermark has passed
    it by a minute. The state is one line a song.
    """
    rows = lines.withWatermark("ts", watermark).withColumns({"norm": normalize(F.col("text")), "weight": weight(F.col("text")).cast("long")})
    return rows.groupBy("song_id").applyInPandasWithState(_step, OUT, STATE, "append", "EventTimeTimeout")
