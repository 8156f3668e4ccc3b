import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cantiga.llm import fuse, jaccard, substrings
from cantiga.llm.columns import U, mix
from cantiga.llm.exact import find_copies
from cantiga.llm.jaccard import Likeness, Tree, schemes, similar_documents
from cantiga.llm.substrings import repeated_passages, tune

from .conftest import EDGES
from .test_columns import split


def noisy(rng, words, share):
    return [w if rng.random() > share else f"n{rng.randint(0, 999)}" for w in words]


def corpus(n=60, seed=3):
    """Families of near copies of many sizes, hubs and chains, exact copies and singles."""
    rng = random.Random(seed)
    out = list(EDGES)
    for k in range(n):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 6, 8, 15, 40, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            out.append((100 + len(out), " ".join(noisy(rng, words, rng.choice([0, 0.005, 0.02, 0.05])))))
    rng.shuffle(out)
    return out


def brute_components(rows, k, part, whole):
    sets = []
    for i, t in rows:
        w = split(t or "")
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and whole * len(x & y) >= part * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "part", "family", "job", "elements"), [(4, 85, 4096, 512, 2_000_000), (5, 80, 2, 3, 2_000_000), (5, 80, 4096, 512, 900)])
def test_components_equal_brute_force(documents, monkeypatch, k, part, family, job, elements):
    for name, value in (("FAMILY", family), ("JOB", job), ("ELEMENTS", elements)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    got = similar_documents(documents(rows), k, Likeness(part, 100)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, k, part, 100)


def test_no_documents_and_only_empty_ones(documents):
    assert similar_documents(documents([])).count() == 0
    assert sorted(map(tuple, similar_documents(documents([(1, None), (2, "")])).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_large_group_of_near_copies_is_one_component(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY", 100)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(noisy(rng, words, 0.003))) for i in range(700)]
    got = similar_documents(documents(rows), 4, Likeness(85, 100)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 4, 85, 100)


def test_classes_hold_every_size_and_enough_parts():
    like = Likeness(85, 100)
    classes = schemes(like, 3000)
    for n in range(1, 3000, 7):
        c = max(k for k in range(len(classes)) if classes[k].low <= n)
        m = min(like.partner(n), 2900)
        d = max(k for k in range(len(classes)) if classes[k].low <= m)
        assert d - c <= 1
        differ = n + m - 2 * like.needed(n + m)
        assert differ == 0 or classes[d].parts > differ


def test_tree_finds_all_components():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 40, 80).astype(np.uint64)) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(15):
            s = b.copy()
            s[rng.integers(0, len(s), 4)] = rng.integers(0, 1 << 40, 4)
            sets.append(np.unique(s))
    sets.sort(key=len)
    like = Likeness(85, 100)
    links = Tree.of(sets).join(like, np.arange(len(sets)))
    root = list(range(len(sets)))
    slow = list(range(len(sets)))

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    for a, b in links:
        root[find(root, a)] = find(root, b)
    for a in range(len(sets)):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 85 * (len(sets[a]) + len(sets[b]) - inter):
                slow[find(slow, a)] = find(slow, b)
    for a in range(len(sets)):
        for b in range(a):
            assert (find(root, a) == find(root, b)) == (find(slow, a) == find(slow, b))


def brute_copies(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return sorted((i, min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


@pytest.mark.parametrize("weak", [False, True])
def test_copies_equal_brute_force_even_if_digests_clash(documents, weak):
    rows = corpus(20) + [(9000 + i, "copy  of\tone") for i in range(40)] + [(9100, "copy of one")]
    bucket = (lambda sha: F.substring(sha, 1, 1)) if weak else (lambda sha: sha)
    got = find_copies(documents(rows), bucket).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_copies(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    assert find_copies(documents([])).count() == 0


def test_filters_have_no_false_negatives():
    for n in (0, 1, 2, 17, 3000):
        keys = mix(np.arange(n, dtype=np.uint64))
        f = fuse.build(keys)
        assert fuse.holds(f, keys).all()
        assert fuse.holds(f, mix(np.arange(1 << 40, (1 << 40) + 5000, dtype=np.uint64))).mean() < 0.02


def test_bands_reach_the_recall():
    bands, rows = tune(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= 24


def test_planted_passages_are_found_and_clean_documents_left_alone(documents):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(n))
    as_line, inside, near = prose(60), prose(90), prose(80).split()
    rows = [(i, prose(200)) for i in range(40)] + list(EDGES)
    rows += [(1000 + i, f"{prose(30)}\n{as_line}\n{prose(30)}") for i in range(5)]
    rows += [(2000 + i, f"{prose(150)} {inside} {prose(150)}") for i in range(5)]
    rows += [(3000 + i, f"{prose(40)}\n{' '.join(near[:i] + ['odd'] + near[i + 1 :])}") for i in range(3)]
    got = repeated_passages(documents(rows)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows if r[0] >= 1000}
    assert {r.doc_id for r in got if not r.removed} == {1000, 2000, 3000}
    texts = dict(rows)
    assert all(as_line in texts[r.doc_id][r.start : r.stop] for r in got if 1000 <= r.doc_id < 2000)
    assert all(texts[r.doc_id][r.start : r.stop] in inside for r in got if 2000 <= r.doc_id < 3000)
    assert repeated_passages(documents([])).count() == 0


def test_first_occurrences_stay_beside_older_passages(documents):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    a, b = prose(40), prose(40)
    rows = [(1, f"{b}\n{prose(20)}"), (2, f"{a}\n{b}"), (3, f"{prose(20)}\n{a}")]
    texts = dict(rows)
    got = repeated_passages(documents(rows), least_words=30).collect()
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.stop].strip(), r.first_doc_id, r.removed) for r in got) == sorted([(1, b, 1, False), (2, a, 2, False), (2, b, 1, True), (3, a, 2, True)])


def test_passages_in_middling_lines_and_over_moved_line_breaks_are_exact(documents):
    rng = random.Random(14)
    prose = lambda n: [f"u{rng.randint(0, 10**7)}" for _ in range(n)]
    inside, moved, mixed = prose(51), prose(70), prose(60)
    wrapped = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    rows = [(10 + i, " ".join(prose(10 + 6 * i) + inside + prose(30 - 6 * i))) for i in range(3)]
    rows += [(20 + i, f"{' '.join(prose(20))} {wrapped(moved, n)} {' '.join(prose(20))}") for i, n in enumerate((9, 13, 70))]
    rows += [(30, " ".join(prose(9) + mixed + prose(9))), (31, " ".join(prose(150) + mixed + prose(150)))]
    rows += [(40 + i, wrapped(prose(300), 20 + i)) for i in range(5)] + list(EDGES)
    texts = dict(rows)
    got = repeated_passages(documents(rows)).collect()
    wanted = [(10 + i, inside, 10, 3) for i in range(3)] + [(20 + i, moved, 20, 3) for i in range(3)] + [(30 + i, mixed, 30, 2) for i in range(2)]
    found = [(r.doc_id, texts[r.doc_id][r.start : r.stop].split(), r.first_doc_id, r.n_docs, r.n_words, r.removed) for r in got]
    assert sorted(found) == sorted((d, w, f, n, len(w), d != f) for d, w, f, n in wanted)


def test_every_repeated_run_of_words_is_covered(documents):
    rng = random.Random(15)
    pool = [[f"p{k}w{j}" for j in range(rng.choice([30, 33, 47, 80]))] for k in range(12)]
    rows = []
    for i in range(1, 40):
        parts = [rng.choice(pool)[rng.randint(0, 3) :] if rng.random() < 0.5 else [f"x{rng.randint(0, 10**8)}" for _ in range(rng.randint(1, 60))] for _ in range(6)]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n"]) for part in parts for w in part)))
    texts = {i: t.split() for i, t in rows}
    runs = {}
    for i, w in texts.items():
        for j in range(len(w) - 29):
            runs.setdefault(tuple(w[j : j + 30]), []).append((i, j))
    wanted, gone = set(), set()
    for at in runs.values():
        if len({i for i, _ in at}) > 1:
            wanted |= {(i, j + k) for i, j in at for k in range(30)}
            gone |= {(i, j + k) for i, j in at for k in range(30) if i != min(at)[0]}
    got, removed = set(), set()
    for r in repeated_passages(documents(rows), least_words=30).collect():
        t = dict(rows)[r.doc_id]
        a = len(t[: r.start].split())
        assert len(t[r.start : r.stop].split()) == r.n_words
        span = {(r.doc_id, a + k) for k in range(r.n_words)}
        assert not span & got
        got |= span
        removed |= span if r.removed else set()
    assert wanted <= got and gone <= removed
    kept = {texts[i][j] for i, j in got - removed} | {w for i in texts for j, w in enumerate(texts[i]) if (i, j) not in got}
    assert {texts[i][j] for i, j in removed} <= kept


def test_passages_of_over_fifty_words_are_found_whatever_stands_around(documents):
    rng = random.Random(16)
    prose = lambda n: [f"q{rng.randint(0, 10**8)}" for _ in range(n)]
    rows, wanted = [], {}
    for k in range(40):
        passage = prose(51 + 3 * k)
        for j in range(2):
            before, after = prose(rng.choice([0, 3, 10, 40, 200])), prose(rng.choice([0, 3, 10, 40, 200]))
            every = before + passage + after
            rows.append((2 * k + j, "".join(w + rng.choice(["\n", "  ", "\t", *" " * 30]) for w in every)))
            wanted[2 * k + j] = passage
    rows += [(1000 + k, " ".join(prose(47) + ["shared"] + prose(30))) for k in range(5)] + [(5000, None)]
    texts = dict(rows)
    got = repeated_passages(documents(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(wanted)
    for r in got:
        found, passage = texts[r.doc_id][r.start : r.stop].split(), wanted[r.doc_id]
        # a near copy of a paragraph may reach a few words further
        assert " ".join(passage) in " ".join(found) and len(found) <= len(passage) + 8


def test_rows_without_id_are_one_document_that_comes_last(documents):
    rng = random.Random(17)
    prose = lambda n: " ".join(f"z{rng.randint(0, 10**8)}" for _ in range(n))
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(None, a), (5, a), (None, b), (None, b), (7, f"{c}\n{prose(9)}"), (7, f"{prose(70)}\n{c}"), (8, c)]
    got = repeated_passages(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.first_doc_id, r.removed) for r in got), key=str) == sorted([(None, 60, 5, True), (5, 60, 5, False), (7, 60, 7, False), (7, 60, 7, False), (8, 60, 7, True)], key=str)


def test_passages_of_a_partition_hold_some_whole_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(substrings, "UNITS", 500)
    rng = np.random.default_rng(18)
    sizes = [*rng.integers(1, 90, 100).tolist(), 3000, *rng.integers(1, 90, 100).tolist()]
    row = np.repeat(np.arange(len(sizes)) << 33, sizes)
    first = np.concatenate([np.arange(n) for n in sizes])
    begin = first * 3
    columns = [row >> 33, row, begin << 32 | (begin + 20), first << 32 | 25, np.where(row >> 34 & 1, row >> 33, 0), np.full(len(row), 2)]
    units = pa.table([pa.array(c) for c in columns], names=["doc_id", "row", "span", "place", "first_doc_id", "n_docs"])
    held = []

    def passages(t):
        held.append(t)
        return substrings._passages(48)(t)

    got = pa.Table.from_batches(substrings._by_text(passages)(iter(units.to_batches(max_chunksize=70))))
    order = lambda t: sorted(t.to_pylist(), key=lambda r: (r["doc_id"], r["start"]))
    assert got.num_rows > 50 and order(got) == order(substrings._passages(48)(units))
    assert sum(t.num_rows for t in held) == len(row) and sorted(t.num_rows for t in held)[-2] < 1000
    texts = [set(t.column("row").to_pylist()) for t in held]
    assert sum(map(len, texts)) == len(sizes) and len(texts) > 10


def test_places_of_a_batch_are_sent_in_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(substrings, "UNITS", 400)
    monkeypatch.setattr(substrings, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("", (), {"partitionId": lambda _: 0})())}))
    rng = random.Random(19)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(4000)) for _ in range(20)]
    every = substrings.Bloom(16)
    every.map[:] = 255

    class Texts:
        sparkSession = spark  # noqa: N815

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    batch = pa.record_batch([pa.array(range(20), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = list(substrings._places_of(Texts(), every, 25)(iter([batch])))
    assert len(parts) > 5
    # every window and every paragraph has its place
    windows = [(r["doc_id"], r["place"] >> 32) for p in parts for r in p.to_pylist() if r["key"] & 1]
    assert sorted(windows) == [(d, k) for d in range(20) for k in range(4000 - 24)]


def test_sets_that_bitmaps_do_not_tell_apart_are_one_row_each():
    rng, like = np.random.default_rng(5), jaccard.Likeness(80, 100)
    values = [np.sort(rng.choice(75, 70, replace=False)).astype(U) for _ in range(90)] + [rng.integers(0, 1 << 40, 75).astype(U) for _ in range(30)]
    order = np.argsort([len(v) for v in values], kind="stable")
    sets, labels = [values[k] for k in order], np.arange(120) // 2
    bits = [jaccard.bitmaps(v, np.array([len(v)]), 512)[0].tobytes() for v in sets]
    size = np.array([len(v) for v in sets])
    columns = [np.full(120, 7), np.arange(120), size, labels]
    job = pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(bits, pa.binary())], names=["job", "id", "n", "label", "set"])
    got = [r for b in jaccard._meeting(like, jaccard.ACROSS)(iter([job])) for r in b.to_pylist()]
    assert 0 < len(got) == len({r["id"] for r in got}) <= 120
    group = {r["id"]: r["job"] for r in got}
    raw = [np.frombuffer(b, np.uint8) for b in bits]
    for a in range(120):
        for b in range(a):
            if labels[a] != labels[b] and np.bitwise_count(raw[a] & raw[b]).sum() + min(size[a] - np.bitwise_count(raw[a]).sum(), size[b] - np.bitwise_count(raw[b]).sum()) >= like.needed(int(size[a] + size[b])):
                assert group[a] == group[b]


def test_signatures_of_a_batch_are_packed_in_bounded_parts(monkeypatch):
    class Documents:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    monkeypatch.setattr(jaccard, "PAIRS", 3000, raising=False)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400)) for _ in range(200)]
    like = Likeness(80, 100)
    run = jaccard._routed(Documents(), 5, like, schemes(like, 1000), np.zeros(0, U), 4)
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    sizes = [sum(map(len, b.column("rows").to_pylist())) // 16 for b in run(iter([batch]))]
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 3


@pytest.mark.parametrize("part", [80, 85])
def test_each_set_tells_its_richest_parts_and_linked_sets_share_one(part):
    rng, like = np.random.default_rng(part), Likeness(part, 100)
    classes = schemes(like, 2000)
    for n in (3, 7, 20, 100, 333):
        for _ in range(40):
            a = rng.integers(0, 1 << 48, n).astype(U)
            b = np.concatenate((a[int(rng.integers(0, max(1, n // 8))) :], rng.integers(0, 1 << 48, int(rng.integers(0, max(1, n // 9)))).astype(U)))
            both = len(np.intersect1d(a, b))
            s = jaccard.Sets(np.concatenate((np.sort(a), np.sort(b))), np.array([0, len(a), len(a) + len(b)]))
            sig, row = jaccard.signatures(s, like, classes)
            for k in (0, 1):
                told = np.unique(sig[row == k] & U(63))
                assert (row == k).sum() == sum(classes[int(c)].parts - classes[int(c)].spare + 1 for c in told)
            if 100 * both >= part * (len(a) + len(b) - both) and len(a) != both:
                assert len(np.intersect1d(sig[row == 0], sig[row == 1]))


@pytest.mark.parametrize("part", [80, 85])
def test_sets_at_the_very_bound_share_a_signature_by_the_bounds_of_their_own_sizes(part):
    rng, like = np.random.default_rng(part), Likeness(part, 100)
    classes = schemes(like, 2000)
    for n in (5, 9, 16, 34, 60, 95, 134, 190, 266, 400, 733):
        for m in np.unique(np.linspace(n, like.partner(n), 5).astype(int)).tolist():
            both = like.needed(n + m)
            if both == n == m:
                continue
            for _ in range(30):
                x = np.unique(rng.integers(0, 1 << 48, 2 * (n + m)).astype(U))
                rng.shuffle(x)
                a, b = np.sort(x[:n]), np.sort(np.concatenate((x[:both], x[n : n + m - both])))
                assert 100 * both >= part * (n + m - both) and len(b) == m
                sig, row = jaccard.signatures(jaccard.Sets(np.concatenate((a, b)), np.array([0, n, n + m])), like, classes, own_bound=True)
                assert len(np.intersect1d(sig[row == 0], sig[row == 1])), (n, m)
                every, of = jaccard.signatures(jaccard.Sets(np.concatenate((a, b)), np.array([0, n, n + m])), like, classes)
                assert all(np.isin(sig[row == k], every[of == k]).all() for k in (0, 1))


def test_single_common_shingles_hardly_chain_sets():
    class Documents:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    phrases = [" ".join(word() for _ in range(20)) for _ in range(301)]
    # each text has 16 of its 160 shingles in common with the one before, and 16 with the next
    texts = [" ".join([*(word() for _ in range(40)), a, *(word() for _ in range(44)), b, *(word() for _ in range(40))]) for a, b in zip(phrases, phrases[1:], strict=False)]
    like = Likeness(80, 100)
    found = list(jaccard._routed(Documents(), 5, like, schemes(like, 1000), np.zeros(0, U), 1)(iter([pa.record_batch([pa.array(texts)], names=["text"])])))
    tied = {tuple(x[1:].tolist()) for b in found for raw in b.column("local").to_pylist() for x in np.frombuffer(raw, U).reshape(-1, 3)}
    assert len(tied) < 20  # of 300
