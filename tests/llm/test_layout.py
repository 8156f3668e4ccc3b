import hashlib
import struct
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cantiga.llm import chat, mixing, packing, stages

from .conftest import EDGES
from .test_columns import split
from .test_duplicates import brute_components, brute_copies, corpus


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB'tsrevl1 \n\t\r\x0b\x1c\xa0　é日🎉<|>endoftext\x01.", max_size=40), st.sampled_from(["ab <|endoftext|> cd", "<|endoftext|>", "x" * 200 + " y", "a\xa0  b", "a \xa0b\xa0", "l'été 's we'll you're've'm", "it''s 'tis a'd's", "“a” — b…", "1½²x"])), max_size=6))
def test_ids_are_those_of_the_unaltered_library(encoder, library, texts):
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library(t) + [0] for t in texts]


def test_what_is_remembered_is_bounded(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 3)
    encoder = packing.Encoder(packing.default_tokenizer())
    for k in range(20):
        texts = [f"word{k} and{j} others, too" for j in range(4)]
        ids, bounds = encoder.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in library(t) + [0]] and bounds[-1] == len(ids)
    assert len(encoder.slots) < 40


def test_pieces_give_the_documents_back_with_little_padding(documents, library):
    rows = corpus(40) + [(4000, "ab <|endoftext|> cd")] + [(5000 + k, " ".join(f"long{j}" for j in range(700))) for k in range(5)]
    got = packing.pack(documents(rows), packing.default_tokenizer(), with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) <= 1024 and zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32
    for i, t in rows:
        if [x[0] for x in rows].count(i) == 1:
            whole = library(t) + [0]
            parts = sorted(by_doc[i], key=lambda r: r.start)
            assert [x for r in parts for x in r.ids] == whole and all(r.doc_tokens == len(whole) for r in parts)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(documents([]), packing.default_tokenizer()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    window, offset, used = packing.best_fit(lengths, 64)
    left, wanted = [], {}
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        fits = [(c, w) for w, c in enumerate(left) if c >= lengths[i]]
        wanted[i] = min(fits)[0] if fits else 64
        w = window[i]
        if w == len(left):
            left.append(64)
        assert left[w] == wanted[i] and offset[i] == 64 - left[w]
        left[w] -= lengths[i]
    assert used == len(left)


TEXT = st.one_of(st.none(), st.text("ab<|\\>%\nimé日_start", max_size=25))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "a%|\n<|"])), TEXT), min_size=1, max_size=8))
def test_turns_come_back_from_the_formatted_bytes(turns):
    buffer, at, begin, end = chat.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    raw = buffer.to_pybytes()
    assert chat.parse(raw.decode()) == [(r or "", t or "") for r, t in turns]
    assert [chat.unescape(raw[a:b].decode()) for a, b in zip(begin, end, strict=True)] == [t or "" for _, t in turns]
    assert raw.decode().count("<|im_start|>") == len(turns)


@pytest.mark.parametrize("part_bytes", [1, 300, 1 << 20])
def test_digests_equal_brute_force_whole_or_in_parts(spark, part_bytes):
    rows = [(c, k, ("user", "assistant", "system", None)[(c or 0 + k) % 4], f"t{k}<|im_end|>\\|é" * (k % 3) or None, "x") for c in (1, 2, 3, None, -5) for k in (*range(40), 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(3)
    got = chat.digests(chat.format_conversations(df, part_bytes=part_bytes)).collect()
    wanted = {}
    for c, k, r, t, _ in rows:
        wanted.setdefault(c, []).append((k, r or "", t or ""))
    assert len(got) == len(wanted)
    for g in got:
        turns = [(r, t) for _, r, t in sorted(wanted[g.conv_id])]
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert g.n_turns == len(turns) and g.loss_chars == len(learnt)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= over


@pytest.mark.parametrize("block", [7, 10_000])
def test_mix_comes_near_its_targets_and_reruns_agree(spark, documents, block):
    rows = [(i, "w " * ((i * 37) % 50)) for i in range(600)] + [(i + 5000, t) for i, t in EDGES]
    full = [(i, t, "src-a" if i % 2 else None if i % 7 == 0 else f"s{i % 5}") for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_sources(mixing.word_counts(df), block=block).collect()
    assert len(got) == len(full)
    size = {}
    for _, t, s in full:
        size[s] = size.get(s, 0) + len(split(t or ""))
    wanted = brute_targets(size)
    for s, n in size.items():
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == n and abs(r.target - wanted[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - wanted[s]) <= max(50, 0.01 * wanted[s])
        assert all(r.taken == r.copies * r.size <= 3 * r.size for r in mine)
    again = mixing.mix_sources(mixing.word_counts(df.repartition(5)), block=block).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(mixing.word_counts(df.limit(0))).count() == 0


def test_flight_keeps_totals():
    import numpy as np

    x, p = np.arange(1, 200) % 23 + 1, np.full(199, 0.37)
    q = mixing.fly(x, p, np.uint64(3))
    assert np.isclose(q.sum(), p.sum()) and np.isclose((q * x).sum(), (p * x).sum()) and ((q > 0) & (q < 1)).sum() <= 2


def test_stages_equal_brute_force_and_keep_all_columns(spark, documents, tmp_path):
    rows = corpus(30) + [(i + 9000, "same text here") for i in range(20)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(rows)
    assert sorted(map(str, stages.quality(spark, docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
    exact = stages.exact(spark, docs, str(tmp_path))
    assert exact.columns == docs.columns
    assert sorted(r.doc_id for r in exact.collect()) == sorted({k for _, k, _, _ in brute_copies(rows)})
    near = stages.near_duplicates(spark, docs, str(tmp_path))
    wanted = {c for _, _, c in brute_components(rows, 5, 80, 100)}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == wanted
    mixed = stages.mix(spark, exact, str(tmp_path))
    taken = mixing.mix_sources(mixing.word_counts(exact))
    assert mixed.columns == docs.columns and mixed.count() == taken.agg({"copies": "sum"}).first()[0]
    assert stages.packed(spark, mixed, str(tmp_path)).agg({"length": "sum"}).first()[0] >= mixed.count()


def test_the_mix_takes_every_row_as_often_as_it_says(spark, tmp_path):
    rows = [(i if i % 5 else None, f"t{i} " * (i % 9), f"s{i % 3}" if i % 4 else None) for i in range(120)] + [(7, "again " * 3, "s1"), (7, "again " * 3, "s1"), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    wanted = {}
    for r in mixing.mix_sources(mixing.word_counts(docs)).collect():
        at = (r.doc_id, r.source, r.size)
        wanted[at] = wanted.get(at, 0) + r.copies
    got = {}
    for r in stages.mix(spark, docs, str(tmp_path)).collect():
        at = (r.doc_id, r.source, len(split(r.text or "")))
        got[at] = got.get(at, 0) + 1
    assert got == {k: n for k, n in wanted.items() if n}


def test_rows_taken_as_often_as_most_of_their_source_are_not_joined_by_id(spark, tmp_path, monkeypatch):
    seen, halves = [], stages._halves

    def spied(*args, **kwargs):
        plain, near = halves(*args, **kwargs)
        seen.append((plain.count(), near.count()))
        return plain, near

    monkeypatch.setattr(stages, "_halves", spied)
    docs = spark.createDataFrame([(i, f"t{i} " * 5, "s" if i % 8 else "t") for i in range(800)] + [(None, "x", "s")], "doc_id long, text string, source string")
    mixed = stages.mix(spark, docs, str(tmp_path)).collect()
    (plain, near) = seen[0]
    assert plain + near == 801 and near < 500
    sized = {r.doc_id: r.copies for r in mixing.mix_sources(mixing.word_counts(docs)).collect()}
    got = dict.fromkeys(sized, 0)
    for r in mixed:
        got[r.doc_id] += 1
    assert got == sized
