"""Sinks: time-tagged lines, subtitles, transcripts, samples."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import pcm16
from ..functions.text import format_lrc


def lrc(lines: DataFrame, order: str = "line_index", titles: DataFrame | None = None) -> DataFrame:
    """(song_id, ord, line): tagged lines by start, ties by `order`; headers of (song_id, title, artist) first, where given."""
    rows = lines.select("song_id", "start_ms", F.col(order).alias("o"), F.concat(F.lit("["), format_lrc(F.greatest(F.lit(0.0), F.col("start_ms"))), F.lit("] "), "text").alias("line"))
    if titles is not None:
        for k, (tag, c) in enumerate((("ti", "title"), ("ar", "artist"))):
            rows = rows.unionByName(titles.where(F.coalesce(c, F.lit("")) != "").select("song_id", F.lit(None).cast("double").alias("start_ms"), F.lit(k).alias("o"), F.concat(F.lit(f"[{tag}:"), c, F.lit("]")).alias("line")))
    at = F.row_number().over(Window.partitionBy("song_id").orderBy(F.asc_nulls_first("start_ms"), "o")) - 1
    return rows.select("song_id", at.alias("ord"), "line")


def write_lines(rows: DataFrame, path: str) -> None:
    """One folder per song, its lines in order in one file."""
    rows.repartition("song_id").sortWithinPartitions("song_id", "ord").select("song_id", "line").write.mode("overwrite").partitionBy("song_id").text(path)


def srt(lines: DataFrame, order: str = "line_index", comma: str = ",") -> DataFrame:
    """(song_id, ord, line): numbered subtitles."""

    def clock(ms: Column) -> Column:
        t = F.greatest(F.lit(0), ms.cast("long"))
        return F.format_string(f"%02d:%02d:%02d{comma}%03d", F.floor(t / 3600000), F.floor(t % 3600000 / 60000), F.floor(t % 60000 / 1000), t % 1000)

    n = F.row_number().over(Window.partitionBy("song_id").orderBy("start_ms", order))
    rows = lines.where("text <> ''").withColumn("n", n)
    return rows.select("song_id", (F.col("n") - 1).alias("ord"), F.concat(F.col("n").cast("string"), F.lit("\n"), clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n")).alias("line"))


def vtt(lines: DataFrame, order: str = "line_index") -> DataFrame:
    return srt(lines, order, ".")


def cache_transcripts(transcripts: DataFrame, path: str) -> None:
    transcripts.write.mode("overwrite").parquet(path)


def verbose(lines: DataFrame) -> DataFrame:
    return lines.select("song_id", F.format_string("[%.2f - %.2f] %.2f %s", F.col("start_ms") / 1000, F.col("end_ms") / 1000, F.col("confidence").cast("double"), F.col("text")).alias("line"))


def progress(percent: Column, stage: Column) -> Column:
    return F.format_string("[progress] %d%% %s", F.greatest(F.lit(0), F.least(F.lit(100), percent.cast("int"))), stage)


def wav(audio: DataFrame, rate: int = 16_000) -> DataFrame:
    """(song_id, content): mono 16-bit files."""

    def run(batches):
        for b in batches:
            out = []
            for s in b["samples"]:
                raw = struct.pack(f"<{len(s)}h", *s)
                out.append(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(raw)) + raw)
            yield pd.DataFrame({"song_id": b["song_id"], "content": out})

    kind = audio.schema["song_id"].dataType.simpleString()
    return audio.select("song_id", pcm16(F.col("samples")).alias("samples")).mapInPandas(run, f"song_id {kind}, content binary")
