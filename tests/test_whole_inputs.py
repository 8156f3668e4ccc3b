"""Kernel queries take every song, line and word of their tables."""

import pytest

from cantiga.queries import QUERIES

LINES = {3: 7, 12: 45, 5: 2}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = [(song, "\n".join(f"line number {k} of song {song}" for k in range(n))) for song, n in LINES.items()]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    frames = [(10 * song + t, song, [0.1 * ((t + k) % 7) for k in range(31)]) for song in (3, 12) for t in range(9)]
    spark.createDataFrame(frames, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize(("name", "line"), [("q_ctc_align", "line"), ("q_refine", "line_index")])
def test_songs_with_frames_are_aligned_whole(spark, tables, name, line):
    got = sorted((r.song_id, r[line], r.text) for r in QUERIES[name](spark, tables).collect())
    assert got == [(song, k, f"line number {k} of song {song}") for song in (3, 12) for k in range(LINES[song])]


def test_block_score_has_every_line_of_every_song(spark, tables):
    got = {r.song_id: r.gt for r in QUERIES["q_block_score"](spark, tables).collect()}
    assert got == LINES | {None: sum(LINES.values())}
