"""Embedding near-dedup against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from loamgrid.llm import embedding_dedup


def brute(rows, least):
    n = len(rows)
    vectors = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, float) if ok else None)
    links = {k: set() for k in range(n)}
    for a in range(n):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k in range(n):
        seen, stack = {k}, [k]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out.append((rows[k][0], len(links[k]), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize(("block", "whole"), [(40, 1000), (40, 60), (8, 8)])
def test_against_all_pairs(spark, monkeypatch, block, whole):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)  # several blocks a label
    monkeypatch.setattr(embedding_dedup, "WHOLE", whole)  # or several tables
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(24)
            for _ in range(int(rng.integers(1, 14))):
                v = centre + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.4])
                rows.append((k, [float(x) for x in v * rng.choice([1.0, 1e-3, 50.0])], label))
                k += 1
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [None] + [1.0] * 23, 0), (1004, [float("nan")] * 24, 0), (1005, [float("inf")] * 24, 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0)]
    rows += [(k + 5000, v, label) for k, v, label in rows[:40]] + [(k + 6000, v, label) for k, v, label in rows[:3]]  # copies
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, block int, width int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    out = embedding_dedup.embedding_dedup(frame)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect())
    assert got == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())


def test_many_links_are_counted_not_listed(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    rows = [(k, [float(x) for x in centre + 0.01 * rng.standard_normal(16)], 1) for k in range(1500)]
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {(r.n_links, r.component_id) for r in out.collect()} == {(1499, 0)}


def test_missing_ids_and_empty_table(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    out = embedding_dedup.embedding_dedup(spark.createDataFrame([(None, [1.0], 1), (2, [1.0], 1)], ddl)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=str) == sorted([(None, 0, None, True), (2, 0, 2, True)], key=str)
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], ddl)).count() == 0


def test_collisions_never_miss_a_pair():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((300, 48))
    a[150:] = a[:150] + 0.35 * rng.standard_normal((150, 48)) / np.sqrt(48) * np.linalg.norm(a[:150], axis=1, keepdims=True)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    found = {tuple(p) for i, j in embedding_dedup.pairs_within(a, a, 0.93, True) for p in zip(i.tolist(), j.tolist(), strict=True)}
    s = a @ a.T
    assert found == {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.93} and found


def test_calibrated_recall():
    """Pairs right at the least cosine share a cell about as often as calibrated; closer ones practically always."""
    rng = np.random.default_rng(4)
    for depth, n in ((6, 1 << 16), (10, 1 << 20)):
        assert embedding_dedup.depth_for(n) == depth
        a = rng.standard_normal((4000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        other = rng.standard_normal((4000, 64))
        other -= (other * a).sum(1, keepdims=True) * a
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * other
        same = embedding_dedup.cells_of(a, n, 0.93) == embedding_dedup.cells_of(b, n, 0.93)
        assert same.any(1).all()
        expected = (1 - np.sqrt(2 / np.pi) / embedding_dedup.RANGE) ** depth
        assert abs(same.mean() - expected) < 0.05 * expected + 0.005
        apart = embedding_dedup.cells_of(a[:2000], n, 0.93) == embedding_dedup.cells_of(a[2000:], n, 0.93)
        assert apart.any(1).mean() < 0.6 if depth == 6 else apart.any(1).mean() < 0.06


def test_windows_of_more_than_sixteen_bits():
    values = np.zeros((66_000, 1))
    lines = embedding_dedup.Projections(values, values[:3], 0.1)
    assert (lines.collisions(np.arange(3), np.arange(66_000)) == 1).all()


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (3, [0.0, 1.0], 1), (0, [0.0, 1.0], 2)]
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(0, 0, 0), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]
