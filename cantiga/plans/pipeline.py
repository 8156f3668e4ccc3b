"""The three ways from inputs to timed lines, for many songs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import lead_shift
from ..operators.intervals import merge_bilingual
from ..operators.lines import minimum_confidence, transcript_lines
from ..operators.lyrics import hint_words, parse_lyrics
from ..operators.words import clean_words, drop_repeated
from ..sources.writers import lrc
from .ctc import align_lines, refine
from .reconcile import reconcile


def _check(method: str, lyrics: DataFrame | None, segments: DataFrame | None, frames: DataFrame | None, boost: float, min_conf: float) -> str:
    method = method or ("a" if lyrics is not None else "b")
    if method not in ("a", "b", "c"):
        raise ValueError(f"unknown method {method!r}")
    if method in "ac" and lyrics is None:
        raise ValueError(f"method {method} needs lyrics")
    if method == "b" and lyrics is not None:
        raise ValueError("method b takes no lyrics")
    if method == "a" and frames is None:
        raise ValueError("method a needs frames")
    if method in "bc" and segments is None:
        raise ValueError(f"method {method} needs a transcript")
    if boost < 0 or not 0 <= min_conf <= 1:
        raise ValueError("boost is 0 or more, min_conf between 0 and 1")
    return method


def timed_lines(
    method: str = "", lyrics: DataFrame | None = None, segments: DataFrame | None = None, secondary: DataFrame | None = None, frames: DataFrame | None = None,
    lead_ms: int = 0, boost: float = 5.0, min_conf: float = 0.0, recover_missing: bool = False,
) -> DataFrame:
    """(song_id, line_index, start_ms, end_ms, confidence, text).

    a: authored lines aligned to frames. b: transcript segments as lines. c: authored lines with the transcript's times. Lyrics are
    raw lines (song_id, line_no, text), segments (song_id, seg, text, start_ms, end_ms, words), `secondary` the segments of a
    second language. Where frames are given, b and c are refined by them. Without a method, lyrics mean a and none b.
    """
    method = _check(method, lyrics, segments, frames, boost, min_conf)
    if segments is not None:
        segments = drop_repeated(segments)
        if secondary is not None:
            segments = merge_bilingual(segments, drop_repeated(secondary)).select(*segments.columns)
    if method == "a":
        lines = parse_lyrics(lyrics).where("not is_ref").select("song_id", F.col("index").alias("line"), "text")
        out = align_lines(frames, lines, boost).withColumnRenamed("line", "line_index")
        out = out.withColumns({c: lead_shift(F.col(c), lead_ms).cast("double") for c in ("start_ms", "end_ms")}) if lead_ms else out
    else:
        if method == "b":
            out = transcript_lines(segments)
        else:
            flat = segments.select("song_id", "seg", F.posexplode("words").alias("pos", "w")).select("song_id", "seg", "pos", "w.*")
            out = reconcile(hint_words(parse_lyrics(lyrics)), clean_words(flat), recover_missing)
            out = out.select("song_id", F.col("ord").alias("line_index"), *(lead_shift(F.col(c), lead_ms).cast("double").alias(c) for c in ("start_ms", "end_ms")), "confidence", "text", "align_text")
        if frames is not None:
            out = refine(out, frames, boost, lead_ms)
    return minimum_confidence(out.select("song_id", "line_index", "start_ms", "end_ms", F.col("confidence").cast("double").alias("confidence"), "text"), min_conf)


def line_files(lines: DataFrame) -> DataFrame:
    """(song_id, ord, line), ready for `sources.writers.write_lines`."""
    return lrc(lines)


def status(songs: DataFrame, lines: DataFrame) -> DataFrame:
    """(song_id, status): songs that gave no line are told, not dropped."""
    some = lines.select("song_id").distinct().withColumn("has", F.lit(True))
    return songs.select("song_id").distinct().join(some, "song_id", "left").select("song_id", F.when(F.col("has"), "ok").otherwise("no lines").alias("status"))
