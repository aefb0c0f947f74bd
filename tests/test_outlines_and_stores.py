"""Polygons with holes and parts against brute force, dataset stores, tiles, features, images, and pattern kernels against numpy."""

from __future__ import annotations

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.config import DatasetConfig
from histomesh.dataset import Dataset, from_xenium
from histomesh.operators import cells as ct
from histomesh.operators import embedding as em
from histomesh.operators import expression as ex
from histomesh.operators import graphs as gr
from histomesh.operators import patterns as pt
from histomesh.operators import plots as pl
from histomesh.operators import shapes as sh
from histomesh.sources import wkb
from histomesh.sources.images import ImageCollection
from tests.test_layout_images import tiff

SQUARE, HOLE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
SMALL = [(10, 0), (11, 0), (11, 1), (10, 1), (10, 0)]


def ellipse(a: float, b: float, n: int, x: float = 0.0, y: float = 0.0) -> list[tuple[float, float]]:
    t = 2 * np.pi * np.arange(n) / n
    ring = list(zip((x + a * np.cos(t)).tolist(), (y + b * np.sin(t)).tolist(), strict=True))
    return [*ring, ring[0]]


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [
        ("hole", wkb.to_wkb(SQUARE, HOLE)), ("turned", wkb.to_wkb(SQUARE[::-1], HOLE[::-1])), ("parts", wkb.to_multi_wkb([SMALL], [SQUARE, HOLE])),
        ("ellipse", wkb.to_wkb(ellipse(6, 2, 400, 30, 30))), ("none", None), ("point", b"\x01\x01\x00\x00\x00" + bytes(16)),
    ]
    raw = spark.createDataFrame(rows, "cell_id string, geometry binary")
    return sh.with_bbox(raw.select("cell_id", wkb.decode("geometry").alias("g")).select("cell_id", "g.*").where("ring is not null")).cache()


def test_wkb():
    assert wkb.rings(wkb.to_wkb(SQUARE, HOLE)) == wkb.rings(wkb.to_wkb(SQUARE[::-1], HOLE[::-1]))
    assert [len(r) for r in wkb.rings(wkb.to_multi_wkb([SMALL], [SQUARE, HOLE]))] == [5, 5, 5] and wkb.outer_ring(wkb.to_multi_wkb([SMALL], [SQUARE]))[2] == (4, 4)
    assert wkb.rings(None) is None and wkb.rings(wkb.to_multi_wkb()) is None


def test_morphology(shapes):
    m = {r.cell_id: r for r in sh.cell_morphology(shapes).collect()}
    assert set(m) == {"hole", "turned", "parts", "ellipse"}
    for name in ("hole", "turned"):
        r = m[name]
        assert (r.area, r.perimeter, r.vertex_count, r.convexity_defects) == (15.0, 20.0, 4, 1.0)
        assert math.isclose(r.centroid_x, (16 * 2 - 1.5) / 15) and math.isclose(r.rectangularity, 15 / 16) and math.isclose(r.solidity, 15 / 16)
    assert m["parts"].area == 16.0 and m["parts"].perimeter == 24.0 and math.isclose(m["parts"].centroid_x, (16 * 2 - 1.5 + 10.5) / 16) and math.isclose(m["parts"].rectangularity, 16 / 44)
    e = m["ellipse"]
    assert abs(e.area - math.pi * 12) < 0.01 and abs(e.eccentricity - math.sqrt(1 - 1 / 9)) < 1e-6 and abs(e.aspect_ratio - 3) < 0.01 and abs(e.elongation - 2 / 3) < 0.01
    # box counting, a vertex at a time: each axis by its own span
    pts = np.array(ellipse(6, 2, 400, 30, 30))[:-1]
    unit = (pts - pts.min(axis=0)) / np.ptp(pts, axis=0)
    n = [len({(int(x * 2**k), int(y * 2**k)) for x, y in unit}) for k in range(1, 8)]
    assert math.isclose(e.fractal_dimension, np.polyfit(np.log(2.0 ** np.arange(1, 8)), np.log(n), 1)[0])


def test_holes_in_queries(shapes):
    ids = lambda df: sorted(r.cell_id for r in df.collect())
    assert ids(sh.query_radius(shapes, 1.5, 1.5, 0.4)) == [] and ids(sh.query_radius(shapes, 1.5, 1.5, 0.6)) == ["hole", "parts", "turned"]
    assert ids(sh.query_radius(shapes, 10.5, 0.5, 0.1)) == ["parts"]
    in_hole = [(1.2, 1.2), (1.8, 1.2), (1.8, 1.8), (1.2, 1.8)]
    assert ids(sh.query_polygon(shapes, in_hole, "intersects")) == [] and ids(sh.query_polygon(shapes, [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8)], "within")) == ["hole", "parts", "turned"]
    assert ids(sh.query_polygon(shapes, [(-1, -1), (5, -1), (5, 5), (-1, 5)], "contains")) == ["hole", "turned"]
    px = {r.cell_id: r for r in sh.scale_polygons(shapes, 0.5, 1).collect()}
    assert px["hole"].ring[2].x == 4.0 and px["hole"].x_max == 4.0 and len(px["parts"].rest) == 2
    with pytest.raises(ValueError):
        sh.scale_polygons(shapes, 0.0)


def test_predicates_against_samples(spark):
    """All six predicates on boxes at random, against sets of grid points."""
    rng = np.random.default_rng(4)
    query = [(2, 2), (7, 2), (7, 7), (2, 7)]
    rows, want = [], {p: [] for p in sh.PREDICATES}
    at = [(x + 0.5, y + 0.5) for x in range(12) for y in range(12)]
    for k in range(60):
        (x0, y0), (w, h) = rng.integers(0, 8, 2).tolist(), rng.integers(1, 5, 2).tolist()
        rows.append((f"c{k:02}", [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h), (x0, y0))]))
        cell = {p for p in at if x0 < p[0] < x0 + w and y0 < p[1] < y0 + h}
        own = {p for p in at if 2 < p[0] < 7 and 2 < p[1] < 7}
        meets = x0 <= 7 and x0 + w >= 2 and y0 <= 7 and y0 + h >= 2
        for p, ok in (("intersects", meets), ("contains", cell <= own), ("covers", cell <= own), ("within", own <= cell), ("covered_by", own <= cell), ("overlaps", bool(cell & own) and not cell <= own and not own <= cell)):
            if ok:
                want[p].append(f"c{k:02}")
    s = sh.with_bbox(spark.createDataFrame(rows, "cell_id string, ring array<struct<x:double,y:double>>"))
    for p in sh.PREDICATES:
        assert sorted(r.cell_id for r in sh.query_polygon(s, query, p).collect()) == want[p], p


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("src")
    (src / "cell_feature_matrix").mkdir()
    put = lambda name, text: gzip.open(src / "cell_feature_matrix" / name, "wt").write(text)
    put("barcodes.tsv.gz", "AA\nBB\nCC\n"), put("features.tsv.gz", "e1\tg1\tx\ne2\tg2\tx\ne3\tg3\tx\n")
    put("matrix.mtx.gz", "%%MatrixMarket matrix coordinate integer general\n3 3 2\n1 1 5\n2 2 7\n")
    rows = [(c, x, y, f"F{k % 2}", 9.0 + k) for k, (c, x, y) in enumerate([("AA", 10.0, 20.0), ("BB", 700.0, 40.0), ("CC", 30.0, 900.0)])]
    spark.createDataFrame(rows, "cell_id string, x_centroid double, y_centroid double, fov_name string, cell_area double").toPandas().to_parquet(src / "cells.parquet")
    (src / "morphology_focus").mkdir()
    (src / "morphology_focus" / "morphology_focus_0000.ome.tif").write_bytes(tiff([np.arange(2 * 20 * 30, dtype=np.uint16).reshape(2, 20, 30)]))
    return from_xenium(spark, str(src), DatasetConfig(str(tmp_path_factory.mktemp("out") / "d"), tile_size=500.0))


def test_stores(spark, data):
    assert set(data.obs_columns()) == {"cell_id", "x", "y", "fov_id", "area", "cell_idx"} and data.n_genes() == 3
    assert [r.cell_idx for r in data.cells.orderBy("cell_idx").collect()] == [0, 1, 2]
    assert [(r.cell, r.cell_idx) for r in data.expression_cells.orderBy("cell_idx").collect()] == [("AA", 0), ("BB", 1), ("CC", 2)]
    data.write_chunk(1, spark.createDataFrame([(0, "g3", 4.0), (1, "g1", 0.0)], "row long, gene string, value double"))
    assert {tuple(r) for r in data.expression.select("cell", "gene", "value").collect()} == {("AA", "g1", 5.0), ("BB", "g3", 4.0)}
    for bad in ([(2, "g1", 1.0)], [(0, "nope", 1.0)]):
        with pytest.raises(ValueError):
            data.write_chunk(1, spark.createDataFrame(bad, "row long, gene string, value double"))
    data.set_gene_names(["a", "b", "c"])
    assert {tuple(r) for r in data.expression.select("cell", "gene", "value").collect()} == {("AA", "a", 5.0), ("BB", "c", 4.0)}
    for bad in (["a", "b"], ["a", "a", "b"]):
        with pytest.raises(ValueError):
            data.set_gene_names(bad)
    with pytest.raises(ValueError):
        ex.select_genes(data.expression, ["nope"])
    assert {(r.gene, r.pos) for r in ex.select_genes(data.expression, ["c", "a", "c"]).collect()} == {("c", 0), ("a", 1), ("c", 2)}
    with pytest.raises(ValueError):
        ct.add_column(data.cells, data.cells.union(data.cells), "area")


def test_tile_views(data):
    views = list(data.iter_tiles())
    assert [v.tile_id for v in views] == [0, 1, 2, 3] and sum(v.cells.count() for v in views) >= 3
    assert [r.cell_id for r in views[0].cells.collect()] == ["AA"] and views[0].boundaries is None and views[0].images.keys() == ["morphology_focus_0000"]


def test_features(spark, data):
    got = lambda name: {r.cell_id: (r.value, r.categorical) for r in data.feature(name).collect()}
    assert got("fov_id") == {"AA": ("F0", True), "BB": ("F1", True), "CC": ("F0", True)}
    gene = data.genes.first().gene
    assert all(not c for _, c in got(gene).values()) and None not in {v for v, _ in got(gene).values()}
    data.results.put("fov_id", spark.createDataFrame([("AA", 3)], "cell_id string, label int"))
    assert got("fov_id")["AA"] == (3, True) and got("fov_id")["BB"][0] is None
    data.results.delete("fov_id")
    with pytest.raises(ValueError):
        data.feature("nothing")
    with pytest.raises(FileNotFoundError):
        data.results.graph("knn_graph")
    data.results.put("knn_graph", spark.createDataFrame([("AA", "BB", 1.0)], "cell_id_a string, cell_id_b string, distance double"))
    assert data.results.graph("knn_graph").count() == 1
    made = []
    make = lambda: made.append(1) or spark.range(2)
    for epochs in (5, 5, 6):
        assert data.results.fitted("model", make, n_epochs=epochs).count() == 2
    assert len(made) == 2 and data.results.keys() == ["knn_graph", "model"]


def test_images(spark, data, tmp_path):
    c = data.image_collection
    assert data.has_images and data.has_morphology and c.default_image == "morphology_focus_0000" and c.pixel_size_at(2) == c.pixel_size * 4 and c.has("morphology_focus_0000")
    assert (c["morphology_focus_0000"].region(3, 4, 5, 2, channel=1) == np.arange(1200).reshape(2, 20, 30)[1, 4:6, 3:8]).all()
    assert c.scale_coordinates(data.cells).where("cell_id = 'AA'").first().x == pytest.approx(10.0 / c.pixel_size)
    with pytest.raises(KeyError):
        c["other"]
    assert ImageCollection(spark, str(tmp_path)).keys() == []
    (tmp_path / "morphology.ome.tif").write_bytes(b"x")
    assert ImageCollection(spark, str(tmp_path)).default_image == "morphology"


def test_opening(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Dataset(spark, DatasetConfig(str(tmp_path)))


# --- kernels against numpy ---
@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.normal(50, 4, (150, 2)), rng.uniform(0, 100, (90, 2)), np.full((6, 2), 7.0)])
    rows = [(f"p{k:03}", float(x), float(y), "ab"[k % 2]) for k, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "cell_id string, x double, y double, cluster string").repartition(3).cache()


def brute(points):
    rows = sorted(map(tuple, points.collect()))
    xy = np.array([r[1:3] for r in rows])
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    return [r[0] for r in rows], xy, np.array([r[3] for r in rows]), d


@pytest.mark.parametrize(("tile", "k"), [(16, 1), (16, 5), (2048, 5), (16, 300)])
def test_nearest(points, monkeypatch, tile, k):
    """Tiles of any size give the nearest points, ties by id, by group and from other places too."""
    monkeypatch.setattr(gr, "TILE", tile)
    monkeypatch.setattr(gr, "EACH", 1)
    ids, _, label, d = brute(points)
    np.fill_diagonal(d, np.inf)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(d[i], kind="stable")[: min(k, len(ids) - 1)]}
    asked = points.select(F.col("cell_id").alias("qid"), "x", "y", "cluster")
    assert {(r.qid, r.cell_id) for r in gr.nearest(asked, points, k).collect()} == want
    apart = np.where(label[:, None] == label, d, np.inf)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(apart[i], kind="stable")[:k] if np.isfinite(apart[i, j])}
    assert {(r.qid, r.cell_id) for r in gr.nearest(asked, points, k, by="cluster").collect()} == want


def test_ripley(points, monkeypatch):
    monkeypatch.setattr(pt, "TILE", 16)
    _, xy, label, d = brute(points)
    for got, name in ((pt.ripley_k(points, 9).collect(), "K"), (pt.ripley_f(points, 9, n_random=40).collect(), "F")):
        rng = np.random.default_rng(42)
        for c in "ab":
            own = xy[label == c]
            (x0, y0), (x1, y1) = own.min(axis=0), own.max(axis=0)
            n, r = len(own), min(x1 - x0, y1 - y0) / 4 * np.arange(1, 10) / 9
            if name == "K":
                near = d[np.ix_(label == c, label == c)][~np.eye(n, dtype=bool)]
                want = (x1 - x0) * (y1 - y0) / (n * (n - 1)) * (near[:, None] <= r + 1e-9).sum(axis=0)
            else:
                at = np.column_stack([rng.uniform(x0, x1, 40), rng.uniform(y0, y1, 40)])
                want = (np.sqrt(((at[:, None] - own) ** 2).sum(axis=2)).min(axis=1)[:, None] <= r).mean(axis=0)
            assert np.allclose([v for _, v in sorted((x.r, x[name]) for x in got if x.cluster == c)], want)


def test_clustering_coefficient(points):
    edges = gr.radius_graph(points, 6.0)
    ids, _, _, d = brute(points)
    near = (d <= 6.0) & ~np.eye(len(ids), dtype=bool)
    k, closed = near.sum(axis=1), np.array([near[np.ix_(row, row)].sum() for row in near])
    want = np.where(k > 1, closed / np.maximum(k * (k - 1), 1), 0.0)
    assert np.allclose([r.clustering_coeff for r in gr.clustering_coefficient(edges, points).orderBy("cell_id").collect()], want)


def test_permutations(points):
    """Labels are dealt out without loss, and p-values are those of shuffled labels."""
    edges, clusters = gr.radius_graph(points, 6.0), points.select("cell_id", "cluster")
    got = {(r.cluster_a, r.cluster_b): r for r in pt.permutation_test(edges, clusters, 300, "count").collect()}
    ids, _, label, d = brute(points)
    a, b = np.nonzero(np.triu(d <= 6.0, 1))
    rng = np.random.default_rng(0)
    count = lambda lab: {("a", "a"): ((lab[a] == "a") & (lab[b] == "a")).sum(), ("a", "b"): (lab[a] != lab[b]).sum(), ("b", "b"): ((lab[a] == "b") & (lab[b] == "b")).sum()}
    seen, null = count(label), [count(rng.permutation(label)) for _ in range(3000)]
    assert set(got) == set(seen)
    for pair, r in got.items():
        sims = np.array([x[pair] for x in null], float)
        assert r.observed_ratio == seen[pair] and abs(r.p_value - (sims >= seen[pair]).mean()) < 0.1 and abs(r.z_score - (seen[pair] - sims.mean()) / sims.std()) < 0.35
    assert {tuple(r) for r in pt.permutation_test(edges, clusters, 300, "count").collect()} == {tuple(r) for r in got.values()}
    one = pt.permutation_test(edges, points.select("cell_id", F.lit("z").alias("cluster")), 5).collect()
    assert [(r.cluster_a, r.observed_ratio, r.p_value) for r in one] == [("z", pytest.approx(1.0, rel=1e3), 1.0)]
    with pytest.raises(ValueError):
        pt.permutation_test(edges, clusters, 5, "other")


def test_envelope_table(points):
    env = pt.dclf_envelope(points, "G", 9, 5)
    drawn = pl.envelope(env).collect()
    assert len(drawn) == 10 and all(r.label == f"{r.cluster} observed (p={e.p_value:.3f})" for r, e in zip(drawn, env.collect(), strict=True))


def test_subsample(points):
    kept = ct.subsample(points, 40)
    first = points.orderBy(F.xxhash64(F.lit(42), "cell_id"), "cell_id").limit(40)
    assert {r.cell_id for r in kept.collect()} == {r.cell_id for r in first.collect()} and ct.subsample(points, 10**6).count() == 246 and ct.subsample(points, 0).count() == 0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(9)
    x = np.abs(rng.normal(0, 1, (60, 3)) @ rng.normal(0, 1, (3, 7)) + rng.normal(0, 0.05, (60, 7)))
    x[rng.random(x.shape) < 0.15] = 0
    return x, spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "cell_id long, v array<double>").repartition(3).cache()


def rows_of(df):
    return np.array([r.v for r in df.orderBy("cell_id").collect()])


@pytest.mark.parametrize("size", [5, 16, 2048])
def test_nearest_vectors(spark, cloud, monkeypatch, size):
    """Blocks of any size give the nearest rows, ties by id, of the table itself and of another one."""
    monkeypatch.setattr(em, "BLOCK", size)
    rng = np.random.default_rng(size)
    x = np.concatenate([cloud[0], cloud[0][:7], rng.integers(0, 2, (30, 7)).astype(float)])
    emb = spark.createDataFrame([(f"r{k:03}", r.tolist()) for k, r in enumerate(x)], "cell_id string, v array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for k in (1, 4, 200):
        want = {(f"r{i:03}", f"r{j:03}") for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[: min(k, len(x) - 1)]}
        got = em.nearest(emb, k).collect()
        assert {(r.cell_id, r.other) for r in got} == want and all(math.isclose(r.d, d[int(r.cell_id[1:]), int(r.other[1:])], abs_tol=1e-12) for r in got)
    y = rng.random((25, 7))
    d = np.sqrt(((y[:, None] - x[None]) ** 2).sum(axis=2))
    other = spark.createDataFrame([(f"q{k:03}", r.tolist()) for k, r in enumerate(y)], "cell_id string, v array<double>")
    assert {(r.cell_id, r.other) for r in em.nearest(other, 3, emb).collect()} == {(f"q{i:03}", f"r{j:03}") for i in range(25) for j in np.argsort(d[i], kind="stable")[:3]}
    assert em.nearest(emb, 3, emb.limit(0)).count() == 0


def test_pca_and_diffmap(cloud):
    x, emb = cloud
    scores, load = em.pca(emb, 3)
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(rows_of(scores)), np.abs(u[:, :3] * s[:3]), atol=1e-6) and (load[np.abs(load).argmax(axis=0), range(3)] > 0).all()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :30]
    width = np.take_along_axis(d, near, 1).max(axis=1)
    w = np.zeros((60, 60))
    for i in range(60):
        for j in near[i]:
            w[i, j] = np.exp(-d[i, j] ** 2 / (width[i] * width[j]))
    w = np.maximum(w, w.T)
    p = w / w.sum(axis=1, keepdims=True)
    got = rows_of(em.diffmap(emb, 4))
    value = np.sort(np.linalg.eigvals(p).real)[::-1]
    for k in range(4):
        assert np.allclose(p @ got[:, k], value[k + 1] * got[:, k], atol=1e-8)


def test_magic(cloud):
    x, emb = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    w = np.zeros((60, 60))
    for i in range(60):
        s = d[i, near[i]].max()
        w[i, near[i]] = np.exp(-((d[i, near[i]] / s) ** 2))
    w = (w + w.T) / 2 + np.eye(60)
    p = w / w.sum(axis=1, keepdims=True)
    assert np.allclose(rows_of(em.magic(emb, 5, 3)), np.linalg.matrix_power(p, 3) @ x)


def test_alra(cloud):
    x, emb = cloud
    got = rows_of(em.alra(emb, 3))
    _, vec = np.linalg.eigh(x.T @ x)
    top = vec[:, ::-1][:, :3]
    low = x @ top @ top.T
    cut = np.abs(np.sort(low, axis=0)[0])
    for j in range(7):
        a = np.where(low[:, j] > cut[j], low[:, j], np.nan)
        pos = x[x[:, j] > 0, j]
        sa = np.nanstd(a, ddof=1)
        want = (a - np.nanmean(a)) * (pos.std(ddof=1) / sa if sa > 0 else 1) + pos.mean()
        want = np.where(np.isnan(a), np.where(x[:, j] > 0, x[:, j], 0), np.maximum(want, 0))
        assert np.allclose(got[:, j], want)


def test_harmony(spark):
    """Batches mix and clusters stay apart."""
    rng = np.random.default_rng(2)
    kind, batch = np.arange(240) % 3, np.arange(240) // 3 % 2
    x = np.eye(6)[kind] * 10 + rng.normal(0, 0.3, (240, 6)) + np.outer(batch, [0, 0, 0, 3, -3, 2])
    emb = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "cell_id long, v array<double>")
    of = spark.createDataFrame([(k, int(b)) for k, b in enumerate(batch)], "cell_id long, batch int")
    z = rows_of(em.harmony(emb, of, 3))
    gap = lambda v, k: np.linalg.norm(v[(kind == k) & (batch == 0)].mean(axis=0) - v[(kind == k) & (batch == 1)].mean(axis=0))
    for k in range(3):
        assert gap(x, k) > 4 and gap(z, k) < 0.5
    centre = np.array([z[kind == k].mean(axis=0) for k in range(3)])
    assert (((z[:, None] - centre) ** 2).sum(axis=2).argmin(axis=1) == kind).all()
    # each batch keeps its own shape: rows are shifted, not squeezed
    assert 0.8 < z[kind == 0].std(axis=0).mean() / 0.3 < 1.3
