import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cantiga.llm import columns as C
from cantiga.llm.stats import Bloom

ALPHABET = "ab C\t\n é日 \x0b|<\\"


def split(t, fold=True):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t) if fold else t
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=20)), max_size=6), st.integers(1, 5))
def test_shingle_sets_equal_those_of_split_words(texts, k):
    s = C.shingle_sets(*C.buffers(pa.array(texts, pa.string())), k)
    wanted = []
    for t in texts:
        w = split(t or "")
        wanted.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    assert np.diff(s.bounds).tolist() == [len(x) for x in wanted]
    mine = [set(s.values[a:b].tolist()) for a, b in zip(s.bounds, s.bounds[1:], strict=False)]
    for i, x in enumerate(wanted):
        for j, y in enumerate(wanted):
            assert len(mine[i] & mine[j]) == len(x & y)


def test_words_do_not_cross_rows_and_slices_keep_their_rows():
    column = pa.array(["left", "right", None, "", "x y"]).slice(1)
    w = C.words(*C.buffers(column))
    assert np.diff(w.bounds).tolist() == [1, 0, 0, 2]
    assert w.hashes[0] == C.words(*C.buffers(pa.array(["right"]))).hashes[0]


def test_many_rows_are_counted_apart():
    rows = np.repeat(np.arange(70_000), 2)
    s = C.sets(np.tile(C.mix(np.arange(2, dtype=np.uint64)), 70_000), rows, 70_000)
    assert (np.diff(s.bounds) == 2).all()


def test_index_and_filter_find_what_they_hold(spark):
    keys = C.mix(np.arange(5000, dtype=np.uint64))
    index = C.Index(keys)
    assert (index.find(keys) == np.arange(5000)).all() and (index.find(keys + np.uint64(1)) == -1).all()
    bloom = Bloom.of(spark.createDataFrame([(int(x),) for x in keys[:500].view(np.int64)], "id long"), 500)
    assert bloom.holds(keys[:500]).all() and bloom.holds(keys[500:]).mean() < 0.05


def test_pieces_cover_all_rows_once():
    sizes = [random.Random(1).randint(0, 300) for _ in range(50)] + [10_000]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    got = list(C.pieces(offsets, 500))
    assert got[0][0] == 0 and got[-1][1] == len(sizes) and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
