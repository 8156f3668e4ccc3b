"""Sources: lyric texts, transcripts, time-tagged lines, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import is_placeholder
from ..functions.text import lrc_seconds, lrc_text, score_normalize, space_words, stem, trim_blank

TRANSCRIPT = (
    "result struct<language:string>, systeminfo string, transcription array<struct<text:string, offsets:struct<from:double,to:double>,"
    " tokens:array<struct<text:string, p:double, offsets:struct<from:double,to:double>>>>>"
)


def lines(texts: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, line_no, text) of (key, text): every line in order, with none for a null text."""
    return texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def read_lyrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(song_id, line_no, text) of text files, named by their stems. A file that cannot be read fails; an empty one has one blank line."""
    files = spark.read.text(paths, wholetext=True).select(stem(F.input_file_name()).alias("song_id"), F.col("value").alias("text"))
    return lines(files)


def lyrics_of(spark: SparkSession, song_id: str, text: str) -> DataFrame:
    """One text at hand, such as standard input."""
    return lines(spark.createDataFrame([(song_id, text)], "song_id string, text string"))


def parse_transcripts(raw: DataFrame) -> DataFrame:
    """(song_id, language, systeminfo, segments, status) of (song_id, text) JSON; missing texts are empty and numbers 0."""
    j = F.from_json("text", TRANSCRIPT, {"mode": "PERMISSIVE"})
    rows = raw.select("song_id", "text", j.alias("j"))
    bad = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty file").when(F.col("j.transcription").isNull(), "no transcription array").otherwise("ok")
    return rows.select("song_id", F.coalesce("j.result.language", F.lit("")).alias("language"), F.coalesce("j.systeminfo", F.lit("")).alias("systeminfo"), F.col("j.transcription").alias("segments"), bad.alias("status"))


def read_transcripts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_transcripts(spark.read.text(paths, wholetext=True).select(stem(F.input_file_name()).alias("song_id"), F.col("value").alias("text")))


def transcript_tokens(transcripts: DataFrame) -> DataFrame:
    """(song_id, seg, pos, text, start_ms, end_ms, prob)"""
    seg = transcripts.select("song_id", F.posexplode("segments").alias("seg", "s"))
    tok = seg.select("song_id", "seg", F.posexplode("s.tokens").alias("pos", "t"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return tok.select("song_id", "seg", "pos", F.coalesce("t.text", F.lit("")).alias("text"), zero("t.offsets.from").alias("start_ms"), zero("t.offsets.to").alias("end_ms"), zero("t.p").alias("prob"))


def transcript_segments(transcripts: DataFrame, words: DataFrame) -> DataFrame:
    """(song_id, seg, text, start_ms, end_ms, words) with the words of `merge_tokens`; segments without any have an empty array."""
    seg = transcripts.select("song_id", F.posexplode("segments").alias("seg", "s"))
    seg = seg.select("song_id", "seg", F.coalesce("s.text", F.lit("")).alias("text"), F.coalesce("s.offsets.from", F.lit(0.0)).alias("start_ms"), F.coalesce("s.offsets.to", F.lit(0.0)).alias("end_ms"))
    item = F.struct("word", "text", "start_ms", "end_ms", "prob")
    inside = words.groupBy("song_id", "seg").agg(F.transform(F.array_sort(F.collect_list(item)), lambda w: F.struct(w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["prob"].alias("prob"))).alias("words"))
    return seg.join(inside, ["song_id", "seg"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<text:string,start_ms:double,end_ms:double,prob:double>>")))


def cached_starts(transcripts: DataFrame) -> DataFrame:
    """(song_id, seg, start_s, text)"""
    seg = transcripts.select("song_id", F.posexplode("segments").alias("seg", "s"))
    return seg.select("song_id", "seg", (F.col("s.offsets.from") / 1000).alias("start_s"), F.col("s.text").alias("text"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def _tagged(rows: DataFrame, line: Column) -> DataFrame:
    line = trim_blank(line)
    return rows.withColumns({"t_s": lrc_seconds(line), "norm": score_normalize(lrc_text(line))}).where(F.col("t_s").isNotNull())


def predicted_lines(raw: DataFrame) -> DataFrame:
    """(song_id, j, t_s, words) of time-tagged lines (song_id, line_no, text); placeholders stay, without words."""
    rows = _tagged(raw, F.col("text")).withColumn("norm", F.when(is_placeholder(F.col("norm")), "").otherwise(F.col("norm")))
    return rows.select("song_id", F.col("line_no").alias("j"), "t_s", space_words(F.col("norm")).alias("words"))


def reference_lines(raw: DataFrame) -> DataFrame:
    """(song_id, i, t_s, words); placeholders and lines without words are left out."""
    rows = _tagged(raw, F.col("text")).where((F.col("norm") != "") & ~is_placeholder(F.col("norm")))
    return rows.select("song_id", F.col("line_no").alias("i"), "t_s", space_words(F.col("norm")).alias("words"))


def song_lines(songs: DataFrame, song_id: object) -> DataFrame:
    """The reference lines of one song of (song_id, synced_lyrics); the predicate reaches the scan."""
    return reference_lines(lines(songs.where(F.col("song_id") == song_id).select("song_id", F.col("synced_lyrics").alias("text"))))


def read_audio(spark: SparkSession, paths: str | list[str], decode) -> DataFrame:
    """(song_id, samples) by a decoder from bytes to mono samples, given by the caller; null samples where it fails."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"song_id": b["song_id"], "samples": [decode(bytes(c)) for c in b["content"]]})

    files = spark.read.format("binaryFile").load(paths).select(stem(F.col("path")).alias("song_id"), "content")
    return files.mapInPandas(run, "song_id string, samples array<float>")


def chunks(audio: DataFrame, samples: int = 960_000) -> DataFrame:
    """(song_id, chunk_no, samples): pieces that do not overlap."""
    n = F.greatest(F.ceil(F.size("samples") / samples), F.lit(1)).cast("int")
    at = F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no")
    return audio.select("song_id", "samples", at).select("song_id", "chunk_no", F.slice("samples", F.col("chunk_no") * samples + 1, samples).alias("samples"))
