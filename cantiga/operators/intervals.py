"""Joins of timed segments by overlap, and the merge of two transcripts of one song."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import mean_probability, segment_score

#: Bucket width of the equi-key that bounds how many pairs of one song are compared.
BUCKET_MS = 60_000


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strictly: intervals that touch do not overlap."""
    return (a_start < b_end) & (b_start < a_end)


def overlap_join(left: DataFrame, right: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Left outer join of (song_id, seg, start_ms, end_ms) rows with every overlapping right row, whose columns get the prefix `o_`.

    Both sides are dealt by song and time bucket, so a long song is many tasks and its segments meet only those near
    them. A pair that shares several buckets counts in the first alone.
    """
    r = right.select(*(F.col(c).alias("o_" + c) for c in right.columns))

    def buckets(start: str, end: str) -> Column:
        a, b = F.floor(F.col(start) / bucket_ms), F.floor(F.col(end) / bucket_ms)
        return F.explode(F.sequence(a, F.greatest(a, b)))

    pairs = left.select("song_id", "seg", "start_ms", "end_ms", buckets("start_ms", "end_ms").alias("bucket")).join(
        r.withColumn("o_bucket", buckets("o_start_ms", "o_end_ms")),
        (F.col("song_id") == F.col("o_song_id")) & (F.col("bucket") == F.col("o_bucket")) & overlaps(F.col("start_ms"), F.col("end_ms"), F.col("o_start_ms"), F.col("o_end_ms"))
        & (F.col("bucket") == F.greatest(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("o_start_ms") / bucket_ms))),
    )
    return left.join(pairs.drop("start_ms", "end_ms", "bucket", "o_bucket", "o_song_id"), ["song_id", "seg"], "left")


def coverage(primary: DataFrame, other: DataFrame) -> DataFrame:
    """(song_id, seg, coverage): the mean over overlapping segments of their words' mean probability; 0 without any."""
    other = other.select("song_id", "seg", "start_ms", "end_ms", mean_probability(F.col("words")).alias("mean"))
    joined = overlap_join(primary.select("song_id", "seg", "start_ms", "end_ms"), other)
    return joined.groupBy("song_id", "seg").agg(F.coalesce(F.avg("o_mean"), F.lit(0.0)).alias("coverage"))


def merge_bilingual(primary: DataFrame, other: DataFrame, margin: float = 0.05) -> DataFrame:
    """The primary's segments and times; text and words from the other transcript where that covers a segment better.

    Adds `score`, `coverage` and `replaced`.
    """
    rows = other.select("song_id", "seg", "start_ms", "end_ms", "text", "words", mean_probability(F.col("words")).alias("mean"))
    joined = overlap_join(primary.select("song_id", "seg", "start_ms", "end_ms"), rows)
    found = F.array_sort(F.collect_list(F.when(F.col("o_seg").isNotNull(), F.struct("o_seg", "o_text", "o_words"))))
    joined = joined.groupBy("song_id", "seg").agg(F.coalesce(F.avg("o_mean"), F.lit(0.0)).alias("coverage"), found.alias("found"))
    out = primary.join(joined, ["song_id", "seg"])
    text = F.array_join(F.filter(F.transform("found", lambda x: x["o_text"]), lambda t: t != ""), " ")
    words = F.flatten(F.transform("found", lambda x: x["o_words"]))
    out = out.withColumns({"score": segment_score(mean_probability(F.col("words")), F.size("words")), "other_text": text, "other_words": words})
    out = out.withColumn("replaced", (F.col("coverage") > F.col("score") + margin) & (F.size("other_words") > 0) & (F.col("other_text") != ""))
    out = out.withColumns({"text": F.when(F.col("replaced"), F.col("other_text")).otherwise(F.col("text")), "words": F.when(F.col("replaced"), F.col("other_words")).otherwise(F.col("words"))})
    return out.drop("found", "other_text", "other_words")
