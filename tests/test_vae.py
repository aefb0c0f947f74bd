from __future__ import annotations

import numpy as np
import pytest

from histomesh.operators.vae import Vae, vae_batch, vae_impute


def test_gradients():
    rng = np.random.default_rng(1)
    model = Vae(7, 2, 3, 5, seed=2)
    x, s, noise = rng.poisson(3, (6, 7)).astype(float), np.eye(2)[rng.integers(0, 2, 6)], rng.normal(size=(6, 3))
    _, grad = model.loss(x, s, noise, 0.7)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, k) for k in value.shape)
            kept, h = value[at], 1e-6
            value[at] = kept + h
            up, _ = model.loss(x, s, noise, 0.7)
            value[at] = kept - h
            down, _ = model.loss(x, s, noise, 0.7)
            value[at] = kept
            assert np.isclose(grad[name][at], (up - down) / (2 * h), rtol=1e-4, atol=1e-6), name


@pytest.fixture(scope="module")
def data(spark):
    """Three kinds of cell in two batches; the second batch has the first ten genes eight times as strong."""
    rng = np.random.default_rng(5)
    share = rng.gamma(0.5, 1, (3, 40)) + 0.02
    rate = np.array([share[i % 3] * np.where(np.arange(40) < 10, 1 + 7 * (i % 2), 1) for i in range(600)])
    rate = 100 * rate / rate.sum(axis=1, keepdims=True)
    x = rng.poisson(rate)
    rows = [(i, f"g{j:02}", float(x[i, j])) for i in range(600) for j in range(40) if x[i, j]]
    return spark.createDataFrame(rows, "cell long, gene string, value double"), spark.createDataFrame([(i, "pq"[i % 2]) for i in range(600)], "cell long, batch string"), x, rate


def test_latent_and_denoised(data):
    expr, batch, x, rate = data
    latent, denoised = vae_batch(expr, batch, n_latent=5, n_epochs=60, n_fit=400)
    z = np.array([r.v for r in latent.orderBy("cell").collect()])
    assert z.shape == (600, 5) and np.isfinite(z).all()
    d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    i = np.arange(600)
    kinds = (near % 3 == (i % 3)[:, None]).mean()
    other = (near % 2 != (i % 2)[:, None]).mean()
    assert kinds > 0.9 and other > 0.2, (kinds, other)
    wide = denoised.toPandas().pivot(index="cell", columns="gene", values="value").to_numpy()
    assert wide.shape == (600, 40) and np.allclose(wide.sum(axis=1), 1e4)
    assert np.abs(wide / 100 - rate).mean() < 0.7 * np.abs(x - rate).mean()


def test_odd_inputs(spark, data):
    expr, batch, *_ = data
    more = batch.union(spark.createDataFrame([(10_000, "p"), (10_001, None)], "cell long, batch string"))
    latent, _ = vae_batch(expr.union(spark.createDataFrame([(1, None, 1.0), (2, "g01", None)], expr.schema)), more, n_latent=2, n_epochs=1)
    assert latent.count() == 601
    assert vae_impute(expr.limit(0)).count() == 0
    assert vae_impute(expr.where("cell < 3"), n_latent=2, n_epochs=1).count() == 3 * expr.where("cell < 3").select("gene").distinct().count()
