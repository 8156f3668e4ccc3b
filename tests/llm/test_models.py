import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from cantiga.llm import columns, hmm, importance, licences, quality_rules
from cantiga.llm.columns import U

from .conftest import EDGES
from .test_columns import split

GOOD = "the river and a house of stone were old when we came home from that town in spring".split()


def labelled(spark, n=160):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randint(60, 120))]
        for k in range(3, len(words), 3):
            words[k] = f"{rng.choice(GOOD)}{rng.randint(0, 10**6)}"
        good = i % 4 != 0
        rows.append((i, " ".join(words if good else [w + rng.choice(["###", "$$$", "&&&"]) for w in words])))
        labels.append((i, int(good), 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute_rules(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
    lines = [x for x in (t or "").split("\n") if split(x)]
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), again, len(covered), failed


def test_statistics_equal_brute_force_and_labels_are_learnt(spark, documents):
    rows, labels = labelled(spark)
    more = [(1000, "a b c\n\na b c\n \nx <|#|>\na b c"), (1001, "go on and " * 40), (1002, "é 日本 " * 30)]
    docs = documents(rows + more + [(i + 2000, t) for i, t in EDGES])
    model = quality_rules.fit(docs, labels)
    got = quality_rules.apply_rules(docs, model).collect()
    texts = dict(rows + more + [(i + 2000, t) for i, t in EDGES])
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in got}
    right = [verdict[i] == (i % 4 != 0) for i, _ in rows]
    assert sum(right) >= 0.98 * len(right)


def test_without_labels_nothing_is_rejected_by_a_model(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, " ".join(f"w{k}" for k in range(60))), *((i + 10, t) for i, t in EDGES)])
    assert {r.doc_id for r in quality_rules.apply_rules(docs, quality_rules.fit(docs, none)).collect() if r.kept} == {1}
    assert all(r.kept for r in importance.resample(docs, importance.fit(docs, none)).collect())
    empty = documents([])
    assert importance.resample(empty, importance.fit(empty, none)).count() == 0
    assert quality_rules.apply_rules(empty, quality_rules.fit(empty, none)).count() == 0


def brute_grams(t):
    """Buckets of a text's words, word pairs and byte triples, each hashed on its own."""
    w, raw = split(t or ""), (t or "").encode()
    h = [int(columns.words(np.array([0, len(x)]), np.frombuffer(x, np.uint8)).hashes[0]) for x in (y.encode() for y in w)]
    pairs = [int(columns.mix(np.array([(a + b * columns._STEP) % 2**64], U))[0]) for a, b in zip(h, h[1:], strict=False)]
    return [x >> 48 for x in h + pairs], [((int.from_bytes(raw[i : i + 3], "little") * 0x9E3779B1) % 2**32) >> 16 for i in range(len(raw) - 2)]


def test_weights_and_top_k_equal_brute_force(spark, documents):
    rows, labels = labelled(spark)
    rows += [(1000 + (i or 0), t) for i, t in EDGES] + [(None, rows[1][1]), (3, "another text under one id")]
    docs = documents(rows)
    model = importance.fit(docs, labels)
    got = importance.resample(docs, model).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    each = [(i, *brute_grams(t)) for i, t in rows]
    weights = [0.0] * len(rows)
    for part in (1, 2):
        raw, good = Counter(), Counter()
        for x in each:
            raw.update(x[part])
            if quality.get(x[0]) == 1:
                good.update(x[part])
        p = {g: (raw[g] + 1) / (sum(raw.values()) + importance.BUCKETS) for g in raw}
        ratio = {g: math.log((0.5 * good[g] / sum(good.values()) + 0.5 * p[g]) / p[g]) for g in raw}
        weights = [w + sum(ratio[g] for g in x[part]) for w, x in zip(weights, each, strict=True)]
    noise = importance.gumbel(np.array([-1 if i is None else i for i, _ in rows]), 0)
    wanted = sorted(((i, w, w + g) for (i, _), w, g in zip(rows, weights, noise, strict=True)), key=str)
    assert len(got) == len(wanted)
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    for r, w in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.key)), sorted(wanted, key=order), strict=True):
        assert r.doc_id == w[0] and math.isclose(r.log_weight, w[1], rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r.key, w[2], rel_tol=1e-9, abs_tol=1e-6)
    k = round(0.75 * len(rows))
    cut = sorted((r.key for r in got), reverse=True)[k - 1]
    assert model.share == 0.75 and all(r.kept == (r.key >= cut) for r in got)
    same = importance.kept_rows(docs, model).collect()
    assert same[0].__fields__ == docs.columns and sorted((r.doc_id for r in same), key=str) == sorted((r.doc_id for r in got if r.kept), key=str)


def test_resampling_tells_labels_it_has_not_seen(spark, documents):
    rows, labels = labelled(spark, 240)
    docs = documents(rows)
    got = {r.doc_id: r for r in importance.resample(docs, importance.fit(docs, labels.where("doc_id % 2 = 0"), share=0.75)).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i, _ in rows)


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 1200])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), 10 ** rng.uniform(-9, 9), 0.25]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert importance.kth_largest(df, k) == (math.inf if k == 0 else -math.inf if k >= 1000 else sorted(values, reverse=True)[k - 1])


def test_gumbel_numbers_have_their_mean():
    g = importance.gumbel(np.arange(200_000), 1)
    assert abs(g.mean() - 0.5772) < 0.01 and abs(g.var() - math.pi**2 / 6) < 0.03


def test_base_scores_equal_brute_force_and_the_model_beats_them(spark, documents):
    rng = random.Random(6)
    topics = [[f"{c}{k}" for k in range(30)] for c in "pqr"]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(rng.randint(20, 60)))) for i in range(300)]
    rows += [(i + 5000, t) for i, t in EDGES]
    got = hmm.score_documents(documents(rows), states=4, symbols=64, head=80).collect()
    tokens = {i: [*split(t or ""), None] for i, t in rows}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update([*split(t or ""), None])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)
    assert hmm.score_documents(documents([])).count() == 0


def naive(model, symbols):
    a = model.start * model.emit[symbols[0]]
    for s in symbols[1:]:
        a = (a @ model.move) * model.emit[s]
    return math.log10(a.sum())


def test_forward_is_exact_and_baum_welch_never_loses():
    rng = np.random.default_rng(1)
    model = hmm.initial(rng.random(9) / 9, 3)
    lengths = [1, 5, 2, 30]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    symbols = rng.integers(0, 9, bounds[-1])
    score = hmm.forward(model, symbols, bounds)
    assert np.allclose(score, [naive(model, symbols[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)])
    into = np.zeros(model.size)
    hmm.expect(model, symbols, bounds, into)
    k = 3
    assert math.isclose(into[:k].sum(), 4) and math.isclose(into[k : k + 9].sum(), bounds[-1] - 4) and math.isclose(into[k + 9 : -1].sum(), bounds[-1])
    likelihood = [into[-1]]
    for _ in range(8):
        counts = into[k + 9 : -1].reshape(-1, k) + 1e-12
        model = hmm.Model(into[:k] / into[:k].sum(), into[k : k + 9].reshape(k, k) / into[k : k + 9].reshape(k, k).sum(1, keepdims=True), counts / counts.sum(0))
        into = np.zeros(model.size)
        hmm.expect(model, symbols, bounds, into)
        likelihood.append(into[-1])
    assert all(b >= a - 1e-9 for a, b in zip(likelihood, likelihood[1:], strict=False))


@pytest.mark.parametrize(("steps", "rescale"), [(1, 1), (7, 3), (1 << 12, 8)])
def test_expected_counts_equal_brute_force_in_blocks_of_any_size(monkeypatch, steps, rescale):
    monkeypatch.setattr(hmm, "STEPS", steps)
    monkeypatch.setattr(hmm, "RESCALE", rescale)
    monkeypatch.setattr(hmm, "POSTERIORS", 20 * steps)
    rng = np.random.default_rng(4)
    k, width, lengths = 4, 12, [60, 1, 33, 33, 2, 1, 9]
    emit, move = rng.random((width, k)) ** 40 + 1e-14, rng.random((k, k)) ** 40 + 1e-11  # next to impossible ones are among them
    model = hmm.Model(np.full(k, 1 / k), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    symbols = rng.integers(0, width, bounds[-1])
    wanted, got = np.zeros(model.size), np.ones(model.size)
    moves, emits = wanted[k : k + k * k].reshape(k, k), wanted[k + k * k : -1].reshape(width, k)
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        e = model.emit[symbols[lo:hi]]
        rows, ahead = [model.start * e[0]], [np.ones(k)]
        for x in e[1:]:
            rows.append(rows[-1] / rows[-1].sum() @ model.move * x)
        for x in e[:0:-1]:
            ahead.append(model.move @ (x * ahead[-1] / ahead[-1].sum()))
        ahead.reverse()
        for t, (f, b) in enumerate(zip(rows, ahead, strict=True)):
            emits[symbols[lo + t]] += f * b / (f @ b)
            if t == 0:
                wanted[:k] += f * b / (f @ b)
            else:
                both = rows[t - 1][:, None] * model.move * (e[t] * b)
                moves += both / both.sum()
            wanted[-1] += math.log10(f.sum())
    hmm.expect(model, symbols, bounds, got)
    assert np.allclose(got - 1, wanted, rtol=1e-9, atol=1e-9)


def test_a_pass_needs_little_memory_beside_what_it_keeps():
    """Fresh memory of a group, of some hundred bytes a token, cost passes more than their sums."""
    rng = np.random.default_rng(5)
    model = hmm.initial(rng.random(500) / 250)
    bounds = np.arange(0, 60_001, 300)
    symbols, into = rng.integers(0, 500, bounds[-1]), np.zeros(model.size)
    hmm.expect(model, symbols, bounds, into)
    tracemalloc.start()
    hmm.expect(model, symbols, bounds, into)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * bounds[-1]


def test_every_word_shares_one_distribution():
    """Symbols and other words together have probability one."""
    count, width = {w: 10 - w for w in range(10)}, 4
    n, v = sum(count.values()), len(count)
    other = n + 0.5 * (v + 1) - sum(count[w] + 0.5 for w in range(width))
    assert math.isclose(sum((count[w] + 0.5) / other for w in range(width, 10)) + 0.5 / other, 1)
    assert U(1) == 1


@pytest.mark.parametrize("family", list(licences.TEMPLATES))
def test_notices_are_confirmed_wherever_they_stand(documents, family):
    notices = licences.TEMPLATES[family]
    rows = [(k, f"some prose before\n{t} and prose\nafter") for k, t in enumerate(notices)]
    got = licences.scan(documents(rows)).collect()
    assert {(r.doc_id, r.paragraph) for r in got if r.family == family and r.confirmed} == {(k, 1) for k in range(len(notices))}


def test_other_paragraphs_are_unknown(documents):
    rows = [(k, t) for k, t in enumerate(licences.COUNTER)] + [(k + 100, t) for k, t in EDGES]
    assert licences.scan(documents(rows)).where("confirmed").count() == 0
    assert licences.scan(documents([])).count() == 0


def test_every_notice_has_a_key_and_columns_equal_python(spark):
    texts = [t for source in (licences.TEMPLATES, licences.VARIANTS) for ts in source.values() for t in ts]
    assert all(any(k in t.lower() for k in licences.KEYS) for t in texts)
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(licences.grams_column(licences.F.col("text")).alias("g")).collect()
    assert [sorted(r.g) for r in got] == [sorted(licences.grams_of(t)) for t in texts]


def test_every_pass_of_training_sees_every_document(spark, documents, monkeypatch):
    seen = []

    def summed(df, columns, count, length):
        into = np.zeros(length)
        for b in df.select(*columns).toArrow().to_batches():
            count(b, into)
        seen.append(round(into[hmm.STATES + hmm.STATES**2 : -1].sum()))
        return into

    monkeypatch.setattr(hmm, "summed", summed)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(GOOD) if i % 2 else f"w{rng.randint(0, 9)}" for _ in range(20))) for i in range(400)]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert hmm.score_documents(documents(rows)).count() == 400
    assert len(train) > 300 and 2 < len(seen) <= hmm.PASSES and set(seen) == {21 * len(train)}


def test_a_notice_without_a_key_is_found(documents):
    text = "Released under MIT."
    assert not any(k in text.lower() for k in licences.KEYS)
    got = licences.scan(documents([(1, f"the river was old\n{text}\nand we came home")])).collect()
    assert [(r.doc_id, r.paragraph, r.family) for r in got] == [(1, 1, "mit")]


def test_words_of_a_long_paragraph_are_found_once(documents):
    text = " ".join(f"w{k % 997}" for k in range(30_000)) + " Released under the MIT License. " + " ".join(f"v{k % 991}" for k in range(30_000))
    began = time.monotonic()
    assert licences.scan(documents([(1, text), (2, "MIT License")])).count() >= 1
    assert time.monotonic() - began < 40


def test_any_of_is_an_alternation():
    words = ["a", "ab", "abc", "b.c", "b-c", "mpl", "mpl-2.0"]
    assert all(re.fullmatch(licences.any_of(words), w) for w in words)
    assert not any(re.fullmatch(licences.any_of(words), w) for w in ("", "ac", "bxc", "mpl-", "mpl-2x0"))


def test_training_reads_symbols_of_texts_of_like_length(documents, monkeypatch):
    monkeypatch.setattr(hmm, "GROUP", 300)
    rows = [(i, "a b c " * (40 if i % 10 == 3 else 1)) for i in range(200)]
    texts = documents(rows)
    (r,) = hmm.coded(texts.coalesce(1), np.array([hmm.END], np.uint64)).collect()
    symbols, lengths = (np.frombuffer(x, "<i4") for x in r)
    assert sorted(lengths.tolist()) == sorted(3 * (40 if i % 10 == 3 else 1) + 1 for i, _ in rows)
    rng = np.random.default_rng(2)
    mixed = rng.permutation(lengths)
    groups = list(hmm.alike([np.where(np.isin(np.arange(mixed.sum()), np.cumsum(mixed) - 1), 0, 1)], [mixed]))
    assert sorted(np.concatenate([n for _, n in groups]).tolist()) == sorted(lengths.tolist())
    assert sum(int(n[0]) for _, n in groups) < 0.8 * 121 * len(groups)
    for s, n in [(symbols, lengths), *groups]:
        ends = np.cumsum(n)
        assert len(s) == ends[-1] and (s[ends - 1] == 0).all() and (s == 0).sum() == len(n)
