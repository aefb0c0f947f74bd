"""Label permutations against a brute-force version on the same hashes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.operators import graphs as gr
from histomesh.operators import near as nr
from histomesh.operators import patterns as pt
from histomesh.plans import catalog
from tests.test_queries import SF


def test_counts_of_every_permutation(spark, monkeypatch):
    monkeypatch.setattr(pt, "EDGES", 50)
    n, reps, rng = 400, 30, np.random.default_rng(3)
    label = rng.choice(["a", "b", "c"], n, p=[0.2, 0.5, 0.3])
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, n, (900, 2)).tolist() if p[0] != p[1]})
    clusters = spark.createDataFrame([(f"c{i}", str(c)) for i, c in enumerate(label)] + [("none", None)], "cell_id string, cluster string").repartition(3)
    edges = spark.createDataFrame([(f"c{a}", f"c{b}", 1.0) for a, b in pairs] + [("c0", "none", 1.0)], "cell_id_a string, cell_id_b string, distance double")
    table = pt.permutation_test(edges, clusters, reps, "count")
    # edges are not multiplied by permutations
    assert "explode" not in table._jdf.queryExecution().toString()
    h = {r.cell_id: r.h for r in clusters.select("cell_id", F.xxhash64(F.lit(42), "cell_id").alias("h")).collect()}
    h = np.array([h[f"c{i}"] for i in range(n)])
    names, dealt = ["a", "b", "c"], np.sort(label)
    a, b = np.array(pairs).T

    def count(of):
        return {(x, y): int((((of[a] == x) & (of[b] == y)) | ((of[a] == y) & (of[b] == x))).sum()) for i, x in enumerate(names) for y in names[i:]}

    null = []
    for rep in range(reps):
        of = np.empty(n, label.dtype)
        of[np.argsort(pt._dealt(h, 42, rep))] = dealt
        null.append(count(of))
    seen = count(label)
    got = {(r.cluster_a, r.cluster_b): r for r in table.collect()}
    assert set(got) == set(seen)
    for pair, r in got.items():
        sims = np.array([x[pair] for x in null], float)
        assert r.observed_ratio == seen[pair] and r.p_value == pytest.approx(((sims >= seen[pair]).sum() + 1) / (reps + 1)) and r.z_score == pytest.approx((seen[pair] - sims.mean()) / sims.std())


@pytest.mark.parametrize(("points", "kinds"), [(16, 3), (256, 6)])
def test_near_as_by_edges(spark, monkeypatch, points, kinds):
    """Counted in tiles as by edges, with copies, points without a place or a cluster and labels in one digit and in several numbers."""
    monkeypatch.setattr(pt, "POINTS", points)
    monkeypatch.setattr(pt, "REPS", 7)
    monkeypatch.setattr(nr, "TILE", 128)
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", float(x), float(y), f"k{k}") for i, (x, y, k) in enumerate(zip(*rng.uniform(0, 30, (2, 500)), rng.integers(0, kinds, 500), strict=True))]
    rows += [(f"z{c}", x, y, "k0") for c, x, y, _ in rows[:300]] + [("lost", None, 1.0, "k1"), ("none", 3.0, 3.0, None)]
    cells = spark.createDataFrame(rows, "cell_id string, x double, y double, cluster string").repartition(3).cache()
    edges = gr.radius_graph(cells.where("x is not null"), 6.0).cache()
    for statistic in ("ratio", "count"):
        want, got = (sorted(map(tuple, t.collect())) for t in (pt.permutation_test(edges, cells, 20, statistic), pt.permutation_test_near(cells, 6.0, 20, statistic)))
        assert len(want) == kinds * (kinds + 1) // 2 and [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose(np.array([r[2:] for r in got]), np.array([r[2:] for r in want]))


@pytest.mark.parametrize("name", ["permutation_test_ratio", "permutation_test_count"])
def test_queries_without_edges(spark, monkeypatch, name):
    def refuse(*a, **k):
        raise AssertionError("a table of edges")

    monkeypatch.setattr(gr, "radius_graph", refuse)
    monkeypatch.setattr(nr, "radius_graph", refuse)
    assert catalog.QUERIES[name](spark, SF).count() == 15
