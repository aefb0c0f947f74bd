from __future__ import annotations

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.config import DatasetConfig
from histomesh.dataset import Dataset, from_merscope, from_xenium
from histomesh.functions.mathx import chi2_sf, normal_sf
from histomesh.operators import autocorrelation as ac
from histomesh.operators import cells as ct
from histomesh.operators import embedding as em
from histomesh.operators import expression as ex
from histomesh.operators import graphs as gr
from histomesh.operators import patterns as pt
from histomesh.operators import shapes as sh
from histomesh.sources.catalog import ResultCatalog
from histomesh.sources.wkb import outer_ring, to_wkb


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(f"c{i}", float(i % 20 * 50), float(i // 20 * 50), i, "ab"[i % 20 >= 10] + "cd"[i >= 100]) for i in range(200)]
    return spark.createDataFrame(rows, "cell_id string, x double, y double, cell_idx long, cluster string").cache()


def test_tails(spark):
    z = [0.0, 0.5, 1.96, 5.0, 7.5, 9.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(normal_sf(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [math.erfc(v / math.sqrt(2)) / 2 for v in z], atol=1e-12)
    assert math.isclose(chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(chi2_sf(4.0, 2), math.exp(-2), rel_tol=1e-12)


def test_config_checks():
    for bad in ({"tile_size": 0}, {"tile_overlap": 600}, {"compression": "gzip"}, {"rows_per_file": 0}):
        with pytest.raises(ValueError):
            DatasetConfig("/x", **bad)


def test_cells(spark, grid):
    with pytest.raises(ValueError):
        ct.select_columns(grid, ["nope"])
    with pytest.raises(ValueError):
        ct.within_bbox(grid, 5, 0, 5, 1)
    with pytest.raises(ValueError):
        ct.validate(grid.union(grid.limit(1)))
    assert ct.within_bbox(grid, 0, 0, 50, 50).count() == 4
    t = ct.tiles(grid, 10_000.0).collect()
    assert len(t) == 1 and t[0].n_cells == 200
    assert ct.tiles(grid.limit(1), 10.0).count() == 1
    assert ct.subsample(grid, 7).collect() == ct.subsample(grid, 7).collect()


def test_graphs(grid):
    r = gr.radius_graph(grid, 60.0)
    assert r.count() == 19 * 10 + 20 * 9 and r.where("cell_id_a >= cell_id_b or distance > 60").count() == 0
    k = gr.knn_graph(grid, 6).collect()
    assert {x.cell_id_a for x in k} | {x.cell_id_b for x in k} == {f"c{i}" for i in range(200)}
    d = gr.diversity(r, grid.select("cell_id", "cluster")).collect()
    assert all(x.shannon >= 0 and 0 <= x.simpson <= 1 for x in d)
    assert gr.clustering_coefficient(r, grid).where("clustering_coeff <> 0").count() == 0


def test_few_points(spark, grid):
    two = grid.limit(2)
    assert gr.knn_graph(two, 10).count() == 1
    assert pt.clark_evans(pt.together(grid.limit(1))).first().p_value == 1.0
    assert gr.radius_graph(grid.limit(0), 5.0).count() == 0


def test_autocorrelation(grid):
    r = gr.radius_graph(grid, 60.0)
    v = ac.one_hot(grid.select("cell_id", "cluster"))
    assert all(x.I > 0 for x in ac.morans_i(r, v).collect()) and all(x.C < 1 for x in ac.gearys_c(r, v).collect())
    flat = ac.morans_i(r, grid.select("cell_id", F.lit("f").alias("feature"), F.lit(1.0).alias("v"))).first()
    assert (flat.I, flat.p_value) == (0.0, 1.0)
    with pytest.raises(ValueError):
        ac.getis_ord(r, grid.select("cell_id", F.col("cluster").alias("v")))


def test_patterns(grid):
    ce = pt.clark_evans(pt.together(grid)).first()
    assert ce.R >= 0.9
    one = pt.permutation_test(gr.radius_graph(grid, 60.0), grid.select("cell_id", "cluster"), 20)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, one.collect())) and one.where("p_value < 0 or p_value > 1").count() == 0
    env = pt.dclf_envelope(grid.where("cluster = 'ac'"), "K", 9, 5).collect()
    assert len(env) == 5 and all(x.lo <= x.hi and 0 <= x.p_value <= 1 for x in env)
    with pytest.raises(ValueError):
        pt.dclf_envelope(grid, "Q")
    f = pt.ripley_f(pt.together(grid), 5, n_random=50).collect()
    assert len(f) == 5 and all(0 <= x.F <= 1 for x in f)


def test_expression(spark):
    rows = [(c, g, float((c * 7 + g) % 5)) for c in range(12) for g in range(6) if (c * 7 + g) % 5]
    e = spark.createDataFrame(rows, "cell long, gene string, value double")
    assert all(abs(r.s - 1e4) < 1e-6 for r in ex.normalize_total(e).groupBy("cell").agg(F.sum("value").alias("s")).collect())
    h = ex.highly_variable_genes(e, 3)
    assert h.where("highly_variable").count() == 3 and ex.highly_variable_genes(e, 99).where("highly_variable").count() == 6
    s = ex.scale(e, h).groupBy("gene").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and (abs(r.s - 1) < 1e-9) for r in s)
    assert ex.pearson_residuals(e).where("abs(value) > sqrt(12) + 1e-9").count() == 0


def test_shapes(spark):
    at = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [("a", at((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))), ("b", at((2, 0), (4, 0), (4, 2), (2, 2), (2, 0))), ("c", at((9, 9), (10, 9), (9, 10), (9, 9))), ("d", at((1, 1), (3, 1), (3, 3), (1, 3), (1, 1)))]
    s = sh.with_bbox(spark.createDataFrame(rows, "cell_id string, ring array<struct<x:double,y:double>>"))
    got = {(r.cell_id_a, r.cell_id_b): round(r.shared_length, 9) for r in sh.contact_graph(s).collect()}
    assert got == {("a", "b"): 2.0, ("a", "d"): 4.0, ("b", "d"): 4.0}
    m = {r.cell_id: r for r in sh.cell_morphology(s).collect()}
    assert (m["a"].area, m["a"].perimeter, m["a"].vertex_count) == (4.0, 8.0, 4) and math.isclose(m["c"].area, 0.5)
    ids = lambda df: sorted(r.cell_id for r in df.collect())
    box = [(-1, -1), (5, -1), (5, 2.5), (-1, 2.5)]
    assert ids(sh.query_polygon(s, box, "contains")) == ["a", "b"] and ids(sh.query_polygon(s, box, "overlaps")) == ["d"]
    assert ids(sh.query_radius(s, 8.5, 9.5, 0.6)) == ["c"] and ids(sh.query_bbox(s, 3.5, 0, 9, 9)) == ["b", "c"]
    with pytest.raises(KeyError):
        sh.cell_by_id(s, "zz")
    assert outer_ring(to_wkb([(0, 0), (1, 0), (0, 1), (0, 0)]))[1] == (1.0, 0.0) and outer_ring(b"") is None


def test_embedding(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (15, 4)) for c in (0, 3, 6)])
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, v array<double>")
    truth = np.repeat([0, 1, 2], 15)
    for labels in (em.kmeans(e, 3, n_init=2), em.hierarchical(e, 3), em.modularity_clusters(e, 5)):
        got = [r.label for r in labels.orderBy("cell_id").collect()]
        assert len(set(zip(truth, got, strict=True))) == 3
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = {(r.cell_id, r.other) for r in em.nearest(e, 4).collect()}
    assert near == {(i, int(j)) for i in range(45) for j in np.argsort(d[i], kind="stable")[:4]}
    scores, load = em.pca(e, 2)
    assert load.shape == (4, 2) and abs(np.mean([r.v for r in scores.collect()])) < 1e-6


def test_results(spark, tmp_path):
    c = ResultCatalog(spark, str(tmp_path))
    assert c.keys() == [] and not c.has("k")
    c.put("k", spark.range(3))
    c.put("k", spark.range(5), force=False)
    assert c.get("k").count() == 3 and c.keys() == ["k"]
    c.put("k", spark.range(5))
    assert c.get("k").count() == 5
    c.delete("k")
    with pytest.raises(KeyError):
        c.get("k")


def test_vendors(spark, tmp_path):
    src = tmp_path / "xenium"
    (src / "cell_feature_matrix").mkdir(parents=True)
    put = lambda name, text: gzip.open(src / "cell_feature_matrix" / name, "wt").write(text)
    put("barcodes.tsv.gz", "AA\nBB\n"), put("features.tsv.gz", "e1\tg1\tx\ne2\tg2\tx\n")
    put("matrix.mtx.gz", "%%MatrixMarket matrix coordinate integer general\n%c\n2 2 3\n1 1 5\n2 1 7\n2 2 70000\n")
    spark.createDataFrame([("c1", 1.0, 2.0, 9), ("c2", 3.0, 4.0, 8)], "cell_id string, x_centroid double, y_centroid double, transcript_counts long").toPandas().to_parquet(src / "cells.parquet")
    spark.createDataFrame([(c, x, y) for c in ("c1", "c2") for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))], "cell_id string, vertex_x double, vertex_y double").coalesce(1).toPandas().to_parquet(src / "cell_boundaries.parquet")
    (src / "experiment.xenium").write_text(json.dumps({"pixel_size": 0.5, "analysis_sw_version": "xenium-3.0.0"}))
    (src / "morphology.ome.tif").write_bytes(b"x")
    data = from_xenium(spark, str(src), DatasetConfig(str(tmp_path / "out")))
    assert {tuple(r) for r in data.expression.collect()} == {("AA", "g1", 5.0), ("AA", "g2", 7.0), ("BB", "g2", 70000.0)}
    assert data.n_cells() == 2 and "transcript_counts" in data.obs_columns() and data.has_boundaries and data.images["default"] == "morphology" and data.images["pixel_size"] == 0.5
    data.save_cells(data.cells.withColumn("z", F.lit(1)))
    assert "z" in data.obs_columns() and data.results.keys() == []
    with pytest.raises(FileExistsError):
        from_xenium(spark, str(src), DatasetConfig(str(tmp_path / "out")))
    with pytest.raises(FileNotFoundError):
        Dataset(spark, DatasetConfig(str(tmp_path / "none")))
    mer = tmp_path / "mer"
    mer.mkdir()
    (mer / "cell_metadata.csv").write_text("EntityID,center_x,center_y,fov,volume\n1,1.5,2.5,0,9.0\n2,3.5,4.5,1,8.0\n")
    (mer / "cell_by_gene.csv").write_text("cell,G1,G2\n1,0,3\n2,4,0\n")
    m = from_merscope(spark, str(mer), DatasetConfig(str(tmp_path / "mer-out")))
    assert {tuple(r) for r in m.expression.collect()} == {("1", "G2", 3.0), ("2", "G1", 4.0)} and not m.has_boundaries
