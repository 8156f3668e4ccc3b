"""Lyric texts with chorus markers as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import chorus_label
from ..functions.text import normalize, trim_blank


def parse_lyrics(raw: DataFrame) -> DataFrame:
    """(song_id, index, text, normalized, is_ref, is_expanded) of raw lines (song_id, line_no, text).

    A marker row stays, unaligned, and the chorus under its label follows: the last block of that label with any line,
    wherever it stands. Blank lines do not end a block, and the lines of a block are also kept where they stand.
    """
    w = Window.partitionBy("song_id").orderBy("line_no")
    rows = raw.withColumn("text", trim_blank(F.coalesce("text", F.lit("")))).withColumn("label", chorus_label(F.col("text")))
    rows = rows.withColumn("block", F.count("label").over(w))
    blocks = rows.where("block > 0").groupBy("song_id", "block").agg(
        F.max("label").alias("label"), F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNull() & (F.col("text") != ""), F.struct("line_no", "text")))), lambda x: x["text"]).alias("lines")
    )
    choruses = blocks.where(F.size("lines") > 0).groupBy("song_id", "label").agg(F.max_by("lines", "block").alias("lines"))
    rows = rows.where((F.col("text") != "") | F.col("label").isNotNull())
    rows = rows.join(choruses, ["song_id", "label"], "left")
    own = F.array(F.struct(F.lit(0).alias("k"), "text", F.col("label").isNotNull().alias("is_ref"), F.lit(False).alias("is_expanded")))
    more = F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda t, i: F.struct((i + 1).alias("k"), t.alias("text"), F.lit(False).alias("is_ref"), F.lit(True).alias("is_expanded")))
    each = rows.select("song_id", "line_no", F.explode(F.concat(own, F.when(F.col("label").isNotNull(), more).otherwise(F.slice(more, 1, 0)))).alias("x")).select("song_id", "line_no", "x.*")
    index = F.row_number().over(Window.partitionBy("song_id").orderBy("line_no", "k")) - 1
    return each.select("song_id", index.alias("index"), "text", F.when(F.col("is_ref"), "").otherwise(normalize(F.col("text"))).alias("normalized"), "is_ref", "is_expanded")


def hint_words(lines: DataFrame) -> DataFrame:
    """(song_id, line, text, words, n_words) of the lines that can be aligned, numbered from 0."""
    rows = lines.where(~F.col("is_ref") & (F.col("normalized") != "")).withColumn("words", F.split("normalized", " "))
    number = F.row_number().over(Window.partitionBy("song_id").orderBy("index")) - 1
    return rows.select("song_id", number.alias("line"), "text", "words", F.size("words").alias("n_words"))
