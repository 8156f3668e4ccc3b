import pytest
from pyspark.sql import functions as F

from cantiga.plans import fixtures, pipeline

DATA = "/root/testdata/sf0.001"


def song(spark):
    words = "we sail the silver sea tonight and home again at last we come".split()
    segments = []
    for seg, part in enumerate((words[:6], words[6:])):
        timed = [(w, 1000.0 * seg * 9 + 400.0 * k, 1000.0 * seg * 9 + 400.0 * k + 300.0, 0.9) for k, w in enumerate(part)]
        segments.append((1, seg, " ".join(part), timed[0][1], timed[-1][2], timed))
    schema = "song_id long, seg int, text string, start_ms double, end_ms double, words array<struct<text:string,start_ms:double,end_ms:double,prob:double>>"
    lyrics = [(1, 0, "Ref."), (1, 1, "We sail the silver sea tonight"), (1, 2, "and home again at last we come")]
    return spark.createDataFrame(segments, schema), spark.createDataFrame(lyrics, "song_id long, line_no int, text string")


def test_transcript_alone_gives_its_segments(spark):
    segments, _ = song(spark)
    got = pipeline.timed_lines("b", segments=segments).orderBy("line_index").collect()
    assert [(r.text, r.start_ms) for r in got] == [("we sail the silver sea tonight", 0.0), ("and home again at last we come", 9000.0)]


def test_lyrics_take_the_transcripts_times(spark):
    segments, lyrics = song(spark)
    got = pipeline.timed_lines("c", lyrics=lyrics, segments=segments, lead_ms=100).where("text <> ''").orderBy("line_index").collect()
    assert got[-1].text == "and home again at last we come" and got[-1].start_ms == 8900.0
    assert pipeline.status(spark.createDataFrame([(1,), (2,)], "song_id long"), pipeline.timed_lines("b", segments=segments)).where("status = 'no lines'").first().song_id == 2


def test_frames_time_lyrics(spark):
    _, lyrics = song(spark)
    frames = spark.range(60).select(F.lit(1).cast("long").alias("song_id"), F.col("id").alias("t"), F.transform(F.sequence(F.lit(0), F.lit(30)), lambda c: (-F.abs(c - F.col("id") % 31)).cast("float")).alias("logp"))
    got = pipeline.timed_lines("a", lyrics=lyrics, frames=frames).collect()
    assert len(got) == 4 and all(r.start_ms <= r.end_ms for r in got)
    assert [r.line for r in pipeline.line_files(spark.createDataFrame(got)).orderBy("ord").collect()][0].startswith("[00:0")


@pytest.mark.parametrize("options", [{"method": "x"}, {"method": "a"}, {"method": "b"}, {"method": "c"}])
def test_lacking_inputs_are_told(options):
    with pytest.raises(ValueError):
        pipeline.timed_lines(**options)


def test_fixtures_name_their_tables():
    assert fixtures.with_sql("timed", "SELECT 1").index("lines AS") < fixtures.with_sql("timed", "SELECT 1").index("timed AS")
