"""Songs, segments, words and frames derived from the driver's tables, since these hold no music."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words_of


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def lines(t: Tables) -> DataFrame:
    """(song_id, line_no, text)"""
    return t.documents.select(F.col("doc_id").alias("song_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def _words(text: Column, start: Column, end: Column, a: int, b: int) -> Column:
    words = words_of(text)
    n = F.size(words)

    def one(w: Column, i: Column) -> Column:
        return F.struct(
            w.alias("text"), (start + (end - start) * i / n).alias("start_ms"), (start + (end - start) * (i + 1) / n).alias("end_ms"), ((i * a + F.length(w) * b) % 100 / 100.0).cast("double").alias("prob")
        )

    return F.transform(words, one)


def segments(t: Tables, shift: float = 0.0, a: int = 37, b: int = 11) -> DataFrame:
    """(song_id, seg, text, start_ms, end_ms, words)"""
    before = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = t.conversations.select(F.col("conv_id").alias("song_id"), F.col("turn").alias("seg"), "text", (10.0 * F.coalesce(before, F.lit(0)) + shift).alias("start_ms"), (10.0 * F.length("text")).alias("ms"))
    rows = rows.withColumn("end_ms", F.col("start_ms") + F.col("ms"))
    return rows.select("song_id", "seg", "text", "start_ms", "end_ms", _words(F.col("text"), F.col("start_ms"), F.col("end_ms"), a, b).alias("words"))


def other_segments(t: Tables) -> DataFrame:
    return segments(t, 130.0, 53, 7)


def words(t: Tables) -> DataFrame:
    """(song_id, seg, pos, text, start_ms, end_ms, prob)"""
    return segments(t).select("song_id", "seg", F.posexplode("words").alias("pos", "w")).select("song_id", "seg", "pos", "w.*")


def sequence(t: Tables) -> DataFrame:
    """(song_id, ord, event_id, event_type, value, start_ms, end_ms)"""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t.events.select(F.col("user_id").alias("song_id"), order.alias("ord"), "event_id", "event_type", "value")
    rows = rows.withColumn("start_ms", F.col("ord") * 1000.0 - F.col("event_id") % 7 * 300.0)
    return rows.withColumn("end_ms", F.col("start_ms") + (F.col("event_id") % 5 - 1) * 400.0)


def tokens(t: Tables) -> DataFrame:
    """(song_id, seg, pos, text, start_ms, end_ms, prob)"""
    kind = F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit(" "), kind)).when(kind == "error", F.concat(F.lit("[_"), kind)).otherwise(kind)
    return sequence(t).select("song_id", F.floor(F.col("ord") / 8).alias("seg"), (F.col("ord") % 8).alias("pos"), text.alias("text"), "start_ms", "end_ms", (F.col("event_id") % 100 / 100.0).cast("double").alias("prob"))


def timed_lines(t: Tables) -> DataFrame:
    """(song_id, line, n_words, matched, start_ms, end_ms, t0, t1): some lines have times of their own."""
    n = F.size(words_of(F.col("text")))
    rows = lines(t).select("song_id", F.col("line_no").alias("line"), n.alias("n_words"))
    matched = (F.col("line") * 7 + F.col("song_id")) % 5 == 0
    start = F.col("line") * 3000.0
    t1 = F.count("*").over(Window.partitionBy("song_id")) * 3000.0
    return rows.select("song_id", "line", "n_words", matched.alias("matched"), F.when(matched, start).alias("start_ms"), F.when(matched, start + 2500.0).alias("end_ms"), F.lit(0.0).alias("t0"), t1.alias("t1"))


def frames(t: Tables) -> DataFrame:
    """(song_id, t, logp)"""
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return t.embeddings.select(F.col("label").cast("long").alias("song_id"), at.alias("t"), F.col("embedding").alias("logp"))


# The same tables as DuckDB expressions, by name.
_SPLIT = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
SQL = {
    "lines": "SELECT doc_id AS song_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)",
    "segments": "SELECT *, start_ms + ms AS end_ms FROM (SELECT conv_id AS song_id, turn AS seg, text, CAST(10.0 * coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start_ms, CAST(10.0 * length(text) AS DOUBLE) AS ms FROM conversations)",
    "words": f"SELECT song_id, seg, pos, text, start_ms + (end_ms - start_ms) * pos / n AS start_ms, start_ms + (end_ms - start_ms) * (pos + 1) / n AS end_ms, CAST((pos * 37 + length(text) * 11) % 100 / 100.0 AS DOUBLE) AS prob FROM (SELECT song_id, seg, start_ms, end_ms, len(ws) AS n, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS text FROM (SELECT *, {_SPLIT.format('text')} AS ws FROM segments))",
    "other_words": f"SELECT song_id, seg, pos, text, CAST((pos * 53 + length(text) * 7) % 100 / 100.0 AS DOUBLE) AS prob FROM (SELECT song_id, seg, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS text FROM (SELECT *, {_SPLIT.format('text')} AS ws FROM segments))",
    "seq": "SELECT *, start_ms + (event_id % 5 - 1) * 400.0 AS end_ms FROM (SELECT *, CAST(ord * 1000.0 - event_id % 7 * 300.0 AS DOUBLE) AS start_ms FROM (SELECT user_id AS song_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, event_id, event_type, value FROM events))",
    "tokens": "SELECT song_id, ord // 8 AS seg, ord % 8 AS pos, CASE event_type WHEN 'click' THEN ' click' WHEN 'error' THEN '[_error' ELSE event_type END AS text, start_ms, end_ms, CAST(event_id % 100 / 100.0 AS DOUBLE) AS prob FROM seq",
    "timed": f"SELECT song_id, line, n_words, matched, CASE WHEN matched THEN line * 3000.0::DOUBLE END AS start_ms, CASE WHEN matched THEN line * 3000.0::DOUBLE + 2500.0 END AS end_ms, 0.0::DOUBLE AS t0, count(*) OVER (PARTITION BY song_id) * 3000.0::DOUBLE AS t1 FROM (SELECT song_id, line_no AS line, len({_SPLIT.format('text')}) AS n_words, (line_no * 7 + song_id) % 5 = 0 AS matched FROM lines)",
}
NEEDS = {"words": ["segments"], "other_words": ["segments"], "tokens": ["seq"], "timed": ["lines"]}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """`body` with the named tables in front of it."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in (*NEEDS.get(name, []), name) if n not in order]
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        parts.append(body[5:])
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
    return "WITH " + ",\n".join(parts) + "\n" + body
