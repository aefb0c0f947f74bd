"""Kernels on all rows, above the former bound of 20000."""

from __future__ import annotations

import numpy as np
import pytest

from histomesh.operators import embedding as em


def chained(x, k):
    """Ward by merging the closest pair each time."""
    parts = [[i] for i in range(len(x))]
    while len(parts) > k:
        c, s = np.array([x[p].mean(axis=0) for p in parts]), np.array([len(p) for p in parts], float)
        d = ((c[:, None] - c) ** 2).sum(axis=2) * s[:, None] * s / (s[:, None] + s)
        np.fill_diagonal(d, np.inf)
        a, b = np.unravel_index(d.argmin(), d.shape)
        parts[a] += parts[b]
        del parts[b]
    return {frozenset(p) for p in parts}


def test_ward_merges_the_closest_pairs(monkeypatch):
    monkeypatch.setattr(em, "ENTRIES", 500)
    rng = np.random.default_rng(2)
    for n, k in ((90, 5), (90, 1), (12, 12), (3, 5)):
        x = rng.normal(size=(n, 3)) + 4 * rng.integers(0, 3, (n, 1))
        got = em.ward(x, k)
        assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got)} == chained(x, k)
    same = em.ward(np.repeat(np.eye(4), 25, axis=0), 4)
    assert [len(set(same[i : i + 25])) for i in range(0, 100, 25)] == [1] * 4 and len(set(same)) == 4


@pytest.fixture
def bounded(spark, monkeypatch):
    """More rows than the bound."""
    monkeypatch.setattr(em, "DRIVER_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = [(f"c{i:03}", (rng.normal(0, 1, 4) + 40 * np.eye(4)[i % 3]).tolist()) for i in range(90)]
    return spark.createDataFrame(rows, "cell_id string, v array<double>")


def parts(table):
    rows = table.collect()
    assert len(rows) == 90 and table.columns == ["cell_id", "label"]
    return {frozenset(int(r.cell_id[1:]) for r in rows if r.label == c) for c in {r.label for r in rows}}


@pytest.mark.parametrize("cluster", [lambda e: em.ward_clusters(e, 3)])
def test_above_the_bound(bounded, cluster):
    assert parts(cluster(bounded)) == {frozenset(range(k, 90, 3)) for k in range(3)}


@pytest.mark.parametrize("refine", [True, False])
def test_communities_above_the_bound(bounded, refine):
    found = parts(em.modularity_clusters(bounded, 8, refine=refine))
    assert all(len({i % 3 for i in p}) == 1 for p in found)


def test_leading_vectors_of_a_graph_in_parts(monkeypatch):
    """Above DENSE rows: as many equal eigenvalues as parts, and the same space as the whole matrix has."""
    rng, n = np.random.default_rng(0), 400
    w = np.zeros((n, n))
    for part in range(4):
        own = np.arange(part, n, 4)
        for i in own:
            w[i, rng.choice(own, 6)] = rng.uniform(0.1, 1, 6)
    w = np.maximum(w, w.T)
    root = np.sqrt(w.sum(axis=1))
    a = w / root[:, None] / root
    row, col = np.nonzero(a)
    whole = em.leading(row, col, a[row, col], n, 6)
    monkeypatch.setattr(em, "DENSE", 10)
    monkeypatch.setattr(em, "ENTRIES", 1 << 12)
    got = em.leading(row, col, a[row, col], n, 6)
    assert np.allclose(got.T @ got, np.eye(6), atol=1e-8)
    values = np.linalg.eigvalsh(a)[::-1][:6]
    assert np.allclose(values[:4], 1) and np.allclose((got * (a @ got)).sum(axis=0), values) and np.allclose(a @ got, got * values, atol=1e-7)
    assert np.allclose(got[:, :4] @ got[:, :4].T, whole[:, :4] @ whole[:, :4].T, atol=1e-7)


@pytest.mark.parametrize(("together", "n_pivots"), [(1, 13), (4, 13), (8, 2)])
def test_blocks_searched_together(spark, monkeypatch, together, n_pivots):
    """The nearest rows whatever number of blocks is searched as one, and no row sent to more groups than there are."""
    n, sent = 400, []
    monkeypatch.setattr(em, "BLOCK", -(-n // n_pivots))
    monkeypatch.setattr(em, "TOGETHER", together)
    checkpointed = em.checkpointed
    monkeypatch.setattr(em, "checkpointed", lambda df: sent.append(checkpointed(df)) or sent[-1])
    x = np.random.default_rng(2).normal(size=(n, 12))
    x[-40:] = x[:40]
    emb = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "cell_id long, v array<double>")
    got = {}
    for r in em.nearest(emb, 5).collect():
        got.setdefault(r.cell_id, []).append((r.d, r.other))
    asks = [df for df in sent if "to" in df.columns]
    if together > 1:
        assert len(asks) == 1 and (asks[0].groupBy("cell_id").count().agg({"count": "max"}).first()[0] or 0) <= -(-2 * n_pivots // together)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(n):
        best = sorted(zip(d[i].tolist(), range(n), strict=True))[:5]
        assert [o for _, o in sorted(got[i])] == [o for _, o in best]
