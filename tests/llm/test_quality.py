"""Quality rules and classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loamgrid.llm import quality_classifier as qc
from loamgrid.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The river ran quietly past the old mill and the garden. "
TEXTS = [
    None, "", " \n\t", "one", GOOD * 2, GOOD * 30, "\n".join(f"River{k} ran past mill{k} and garden{k}, where stone{k} stands alone{k}." for k in range(9)), "Menu | Home | About | Contact\n" * 12 + GOOD, "é ß ü. " * 60, "LOUD WORDS AGAIN AND AGAIN " * 10,
    "\n".join(f"Some words number {k} without any ending at all here" for k in range(12)), "a b c d " * 40, "# * $ % & | < >" * 9, "x" * 100_000, "All rights reserved by nobody.\n" + " ".join(f"word{k}." for k in range(80)),
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n, seen, dup = len(words), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(n - 2)]
    counts, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {k, k + 1, k + 2}
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rules(spark):
    rows = [*enumerate(TEXTS), (None, GOOD * 8), (3, "one")]
    frame = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    out = qr.quality_rules(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None or r.doc_id == 3:
            continue
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in out}
    assert by[6].kept and not by[7].kept and not by[10].kept and by[10].n_punctuation == 12
    assert by[14].kept and by[14].n_boilerplate == 1 and "rights" not in by[14].cleaned_text
    assert qr.quality_rules(frame.limit(0)).count() == 0


def test_features_have_one_length():
    for t in TEXTS:
        x = qc.features((t or "").encode())
        assert len(x) == qc.N_FEATURES and np.isfinite(x).all()


def test_long_texts_are_sliced(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [(t or "").encode() for t in TEXTS] + [" ".join(rng.choice(["a.", "b", "c!", "Dé", "x\n", "  "], 3000)).encode() for _ in range(5)]
    wanted = [(qc.features(t), qr.judge(t, qr.LineRules())) for t in texts]
    monkeypatch.setattr(qc.common, "SLICE_BYTES", 64)
    monkeypatch.setattr(qc.common.slices, "__defaults__", (64,))
    assert [(qc.features(t), qr.judge(t, qr.LineRules())) for t in texts] == wanted
    monkeypatch.undo()
    raw = b"word and some more words. " * 400_000  # 10 MB in one line
    assert qc.WordStats.of(raw) == qc.WordStats(2_000_000, 5, 400_000, 0, 400_000, 5)
    assert qr.judge(raw, qr.LineRules())[:2] == (2_000_000, 21 * 400_000)


def test_the_prior_comes_from_positives_and_unlabelled_scores():
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.6, 0.9):
        n = 40_000
        good, bad = np.clip(rng.normal(200, 20, n), 0, 255).astype(int), np.clip(rng.normal(60, 30, n), 0, 255).astype(int)
        count = lambda x: np.bincount(x, minlength=256).astype(float)
        assert abs(qc.estimated_prior(count(good), count(np.concatenate([good[: int(prior * n)], bad[int(prior * n) :]]))) - prior) < 0.02


def test_positive_unlabelled_learning():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (4000, 5)), rng.normal(-1, 1, (1500, 5))
    unlabelled = np.concatenate([good[2000:], bad[:700]])
    basis = qc.Basis.of([np.quantile(unlabelled[:, k], qc.QUANTILES).tolist() for k in range(5)])
    moment = lambda x: basis(x).T @ basis(x) / len(x)
    model = qc.Model(basis, qc.fit(moment(good[:2000]), moment(unlabelled), 2000 / 2700), 2000 / 2700)
    assert (model.score(good[:1000]) > 0.5).mean() > 0.95 and (model.score(bad[700:]) > 0.5).mean() < 0.15


def test_moments_cover_all_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.random((700, qc.N_FEATURES)).astype(np.float32)
    known = rng.integers(0, 2, 700)
    frame = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(known, x, strict=True)], "known int, x array<float>").withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(2)).cast("int")).repartition(5)
    basis = qc.Basis.of([[0.1, 0.1, 0.5, 0.9]] * (qc.N_FEATURES - 1) + [[0.3]])
    found = qc.moments(frame, basis)
    assert set(found) == {(a, b) for a in (0, 1) for b in (0, 1)}
    for value in (0, 1):
        own = basis(x[known == value].astype(float))
        n, moment = qc._pooled([found[value, f] for f in (0, 1)])
        assert n == len(own) and np.allclose(moment, own.T @ own / n)


def test_held_out_accuracy(spark):
    bad = ["Menu | Home | About | " * 12, "BUY!! NOW!! CHEAP!! " * 20, "spam spam spam spam " * 30, "gr### ab$$$ cd%%% ef&&& " * 15]
    rows, labels = [], []
    for k in range(600):
        good = k % 4 != 0
        text = " ".join(f"Word{(k * 7 + j * j) % 211} and river{(k + j) % 97} ran past." for j in range(12)) if good else bad[k // 4 % 4] + f" {k}"
        rows.append((k, text, "en"))
        if k % 3:
            labels.append((k, int(good)))
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "en"), (None, GOOD, None)], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, quality int")
    rows_ = qc.feature_table(docs)
    model = qc.train(rows_, marks)
    out = {r.doc_id: r for r in qc.score_quality(rows_, model).collect()}
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items() if k is not None)
    held = [(out[k].predicted, int(k % 4 != 0)) for k in range(600) if out[k].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    kept = qc.keep_good(qc.feature_table(docs, carry=tuple(docs.columns)), model, docs.columns)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.predicted}


def brute_model(rows: list[tuple[int, str]], labels: dict[int, int], folds: dict[int, int], quantiles) -> qc.Model:
    """Training in plain numpy over rows held in memory."""
    x = np.array([qc.features((t or "").encode()) for _, t in rows], np.float32).astype(float)
    basis = qc.Basis.of(quantiles)
    b, fold = basis(x), np.array([folds[i] for i, _ in rows])
    un = np.array([i not in labels for i, _ in rows])
    pos = np.array([labels.get(i) == 1 and zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows])
    moment = lambda m: b[m].T @ b[m] / m.sum()
    decay = lambda p, u: 3e-3 + 0.015 * basis.size / min(p.sum(), u.sum())
    counts = {True: np.zeros(qc.STEPS), False: np.zeros(qc.STEPS)}
    for f in (0, 1):
        p, u = pos & (fold != f), un & (fold != f)
        scores = np.clip((b @ qc.fit(moment(p), moment(u), qc.START, decay=decay(p, u)) + 1) / 2, 0, 1)
        for kind, mask in ((True, pos), (False, un)):
            counts[kind] += np.bincount(np.minimum(scores[mask & (fold == f)] * qc.STEPS, qc.STEPS - 1).astype(int), minlength=qc.STEPS)
    prior = qc.estimated_prior(counts[True], counts[False])
    return qc.Model(basis, qc.fit(moment(pos), moment(un), prior, decay=decay(pos, un)), prior)


def test_training_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    table = qc.feature_table(docs)
    folds = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).collect()}
    q = table.agg(*(F.percentile_approx(F.col("x")[k], list(qc.QUANTILES)) for k in range(qc.N_FEATURES))).first()
    want = brute_model(rows, {r.doc_id: r.quality for r in labels.collect()}, folds, [list(v) for v in q])
    model = qc.train(table, labels)
    assert np.isclose(model.prior, want.prior) and np.allclose(model.weights, want.weights, atol=1e-6)
    x = np.array([qc.features((t or "").encode()) for _, t in rows], np.float32).astype(float)
    scores = {r.doc_id: r.score for r in qc.score_quality(table, model).collect()}
    assert np.allclose([scores[i] for i, _ in rows], want.score(x), atol=1e-6)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = qc.feature_table(docs)
    assert qc.train(rows, none) is None and qc.train(qc.feature_table(docs.limit(0)), none) is None
    assert [r.score for r in qc.score_quality(rows, None).collect()] == [0.5]
    assert qc.score_quality(rows.limit(0), None).count() == 0
    assert qc.keep_good(qc.feature_table(docs.limit(0), carry=tuple(docs.columns)), None, docs.columns).count() == 0
