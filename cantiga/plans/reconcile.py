"""Lyrics reconciled with a transcript: authored text, transcript times."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import MARKERS, is_marker
from ..functions.text import normalize
from ..operators import timeline
from ..operators.kernels import align_words, mirror


def align(hints: DataFrame, words: DataFrame) -> DataFrame:
    """(song_id, line, hint_word, widx, sim): every pair on the best path, of hints (song_id, line, words) and cleaned words."""
    hints = hints.select("song_id", F.col("line").cast("int").alias("line"), "words")
    words = words.select("song_id", F.col("widx").cast("int").alias("widx"), "norm", "start_ms", "end_ms")

    def run(h: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        columns = ["song_id", "line", "hint_word", "widx", "sim"]
        if h.empty or w.empty:
            return pd.DataFrame(columns=columns)
        h, w = h.sort_values("line"), w.sort_values("widx")
        flat = [(line, k, x) for line, xs in zip(h["line"], h["words"], strict=True) for k, x in enumerate(xs)]
        found = align_words([x for _, _, x in flat], w["norm"].tolist(), w["start_ms"].to_numpy(), float(w["start_ms"].iloc[0]), float(w["end_ms"].iloc[-1]))
        at = w["widx"].tolist()
        return pd.DataFrame([(h["song_id"].iloc[0], flat[i][0], flat[i][1], at[j], s) for i, j, s in found], columns=columns)

    return hints.groupBy("song_id").cogroup(words.groupBy("song_id")).applyInPandas(run, "song_id long, line int, hint_word int, widx int, sim double")


def line_times(hints: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(song_id, line, n_words, coverage, matched, start_ms, end_ms, t0, t1); times null where the match is too weak."""
    span = words.groupBy("song_id").agg(F.min_by("start_ms", "widx").alias("t0"), F.max_by("end_ms", "widx").alias("t1"))
    timed = pairs.join(words.select("song_id", "widx", "start_ms", "end_ms"), ["song_id", "widx"])
    found = timed.groupBy("song_id", "line").agg(F.count_if(F.col("sim") >= 0.60).alias("good"), F.min_by("start_ms", "widx").alias("start_ms"), F.max_by("end_ms", "widx").alias("end_ms"))
    rows = hints.select("song_id", "line", "n_words").join(span, "song_id").join(found, ["song_id", "line"], "left")
    rows = rows.withColumn("coverage", F.coalesce("good", F.lit(0)) / F.col("n_words"))
    told = F.col("coverage") >= 0.15
    return rows.select(
        "song_id", "line", "n_words", "coverage", (F.col("coverage") >= 0.40).alias("matched"), F.when(told, F.col("start_ms")).alias("start_ms"), F.when(told, F.col("end_ms")).alias("end_ms"), "t0", "t1"
    )


_REBUILT = "song_id long, line int, text string, start_ms double, end_ms double, covered array<int>"


def _rebuild(rows: pd.DataFrame) -> pd.DataFrame:
    """The text of one weakly matched line from the words between its anchors."""
    rows = rows.sort_values("widx")
    anchors = set(rows.loc[rows["anchor"], "widx"])
    inner = rows["end_ms"].iloc[-1] - rows["start_ms"].iloc[0] <= (len(anchors) + 2) * 600.0
    out, last, covered = [], None, set(anchors)
    for r in rows.itertuples():
        if r.marker:
            continue
        if r.widx not in anchors and (not inner or last is None or r.start_ms - last >= 900.0):
            continue
        out.append(r.text)
        last = r.end_ms
        covered.add(r.widx)
    return pd.DataFrame([(rows["song_id"].iloc[0], rows["line"].iloc[0], " ".join(out).strip(" "), rows["start_ms"].iloc[0], rows["end_ms"].iloc[-1], sorted(int(k) for k in covered))], columns=["song_id", "line", "text", "start_ms", "end_ms", "covered"])


def reconcile(hints: DataFrame, words: DataFrame, recover_missing: bool = False) -> DataFrame:
    """(song_id, ord, text, align_text, start_ms, end_ms, from_hint, recovered, confidence) with blank rows at long gaps.

    Confidence is 0.8 for matched lines, 0.4 for lines rebuilt from the transcript, 0.3 for lines known from the lyrics alone, 0.5 for
    recovered ones and 0 for blanks. Songs without words or without lines have no rows; `status` tells which.
    """
    words = words.withColumn("marker", is_marker(normalize(F.col("text"))))
    pairs = align(hints, words)
    times = line_times(hints, words, pairs)
    song = Window.partitionBy("song_id")
    times = times.withColumn("trusted", F.max("matched").over(song))
    filled = timeline.interpolate_lines(times.select("song_id", "line", "n_words", "matched", "start_ms", "end_ms", "t0", "t1", "trusted"))
    anchors = pairs.where("sim >= 0.50").select("song_id", "line", "widx")
    ranges = anchors.groupBy("song_id", "line").agg(F.min("widx").alias("first"), F.max("widx").alias("last"))
    weak = filled.where("not matched and trusted").join(ranges, ["song_id", "line"])
    inside = weak.select("song_id", "line", "first", "last").join(words, "song_id").where(F.col("widx").between(F.col("first"), F.col("last")))
    inside = inside.join(anchors.withColumn("anchor", F.lit(True)), ["song_id", "line", "widx"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    rebuilt = inside.select("song_id", "line", "widx", "text", "start_ms", "end_ms", "marker", "anchor").groupBy("song_id", "line").applyInPandas(_rebuild, _REBUILT)
    r = rebuilt.select("song_id", "line", F.col("text").alias("r_text"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    lines = filled.join(hints.select("song_id", "line", "text"), ["song_id", "line"]).join(r, ["song_id", "line"], "left")
    own, new = F.col("matched"), F.col("r_text").isNotNull()
    start = F.greatest(F.lit(0.0), F.col("start_ms"))
    base = lines.select(
        "song_id", "line", F.when(new, F.col("r_text")).otherwise(F.col("text")).alias("text"), F.when(own | new, F.col("text")).otherwise("").alias("align_text"),
        F.when(new, F.col("r_start")).otherwise(start).alias("start_ms"), F.when(new, F.col("r_end")).otherwise(F.when(F.col("end_ms") < 0, start + 1000.0).otherwise(F.col("end_ms"))).alias("end_ms"),
        (~new).alias("from_hint"), F.when(own, 0.8).when(new, 0.4).otherwise(0.3).alias("confidence"),
    )
    base = timeline.clamp_monotone(base, "line")
    if recover_missing:
        used = anchors.join(filled.where("trusted and matched").select("song_id", "line"), ["song_id", "line"]).select("song_id", "widx")
        covered = used.unionByName(rebuilt.select("song_id", F.explode("covered").alias("widx"))).distinct()
        sure = words.join(times.groupBy("song_id").agg(F.max("trusted").alias("trusted")).where("trusted").select("song_id"), "song_id", "left_semi")
        more = recover(hints, sure, covered)
    else:
        more = base.limit(0)
    out = timeline.merge_recovered(base, more.select(base.columns))
    out = timeline.paragraph_breaks(out, "ord")
    blank = lambda name, value: F.when(F.col("blank"), F.lit(value)).otherwise(F.col(name)).alias(name)
    order = F.row_number().over(Window.partitionBy("song_id").orderBy("ord", "blank")) - 1
    return out.select("song_id", order.alias("ord"), blank("text", ""), blank("align_text", ""), "start_ms", "end_ms", blank("from_hint", False), blank("recovered", False), blank("confidence", 0.0))


def recover(hints: DataFrame, words: DataFrame, covered: DataFrame) -> DataFrame:
    """Lines of transcript words that no authored line covers, shaped like the authored lines where they resemble them."""
    runs = timeline.uncovered_runs(words, covered).select("song_id", "run_start", "run_end")
    inside = runs.join(words.select("song_id", "widx", "text", "norm", "start_ms", "end_ms", "prob", "marker"), "song_id").where(F.col("widx").between(F.col("run_start"), F.col("run_end")))
    lyrics = hints.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("line", "text", "words"))).alias("lyrics"))
    rows = inside.groupBy("song_id", "run_start").agg(F.array_sort(F.collect_list(F.struct("widx", "text", "norm", "start_ms", "end_ms", "prob", "marker"))).alias("run")).join(lyrics, "song_id")

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                texts = {h["line"]: h["text"] for h in r.lyrics}
                flat = [(h["line"], x) for h in r.lyrics for x in h["words"]]
                ws = list(r.run)
                tags = mirror([w["norm"] for w in ws], [x for _, x in flat], [line for line, _ in flat])
                for group, line in _groups(ws, tags):
                    kept = [w["text"] for w in group if not w["marker"]]
                    text = " ".join(kept).strip(" ")
                    if len(group) >= 2 and sum(w["prob"] for w in group) / len(group) >= 0.45 and text:
                        out.append((r.song_id, int(group[0]["widx"]), text, texts.get(line, ""), float(group[0]["start_ms"]), float(group[-1]["end_ms"]), False, 0.5))
            yield pd.DataFrame(out, columns=["song_id", "line", "text", "align_text", "start_ms", "end_ms", "from_hint", "confidence"])

    return rows.mapInPandas(run, "song_id long, line int, text string, align_text string, start_ms double, end_ms double, from_hint boolean, confidence double")


def _groups(words: list, tags: list[int] | None):
    """Words that become a line each, with the authored line they follow, or -1."""
    now, before = [], -1
    for k, w in enumerate(words):
        if tags is None:
            new = bool(now) and w["start_ms"] - now[-1]["end_ms"] >= 900.0
        else:
            new = bool(now) and tags[k] != before
        if new:
            yield now, before
            now = []
        if tags is not None and tags[k] >= 0:
            before = tags[k]
        now.append(w)
    if now:
        yield now, before


def status(songs: DataFrame, hints: DataFrame, words: DataFrame) -> DataFrame:
    """(song_id, status): ok, or why a song has no lines."""
    w, h = words.select("song_id").distinct().withColumn("w", F.lit(1)), hints.select("song_id").distinct().withColumn("h", F.lit(1))
    rows = songs.select("song_id").distinct().join(w, "song_id", "left").join(h, "song_id", "left")
    return rows.select("song_id", F.when(F.col("w").isNull(), "no transcript words").when(F.col("h").isNull(), "no hint words").otherwise("ok").alias("status"))


__all__ = ["MARKERS", "align", "line_times", "reconcile", "recover", "status"]
