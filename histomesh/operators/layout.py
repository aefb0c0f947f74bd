"""Two-dimensional layouts of embeddings: UMAP and t-SNE.

Neighbours and edge weights are tables. The layout itself is a kernel on the driver over at most n_fit rows, chosen by seeded hash of
their ids; every other row is placed among them, as the weighted mean of its nearest fitted rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.operators.cells import subsample
from histomesh.operators.embedding import DRIVER_ROWS, matrix, nearest
from histomesh.sources.catalog import checkpointed

#: Rows that the t-SNE kernel, which holds all pairs, takes at most.
TSNE_ROWS = 3000


def smooth_weights(d: np.ndarray) -> np.ndarray:
    """d: rows x k distances, ascending. exp(-(d - least) / s), s such that a row's weights sum to log2(k)."""
    over = np.maximum(d - d[:, :1], 0)
    want = np.log2(max(d.shape[1], 2))
    lo, hi, s = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        much = np.exp(-over / s[:, None]).sum(axis=1) > want
        hi, lo = np.where(much, s, hi), np.where(much, lo, s)
        s = np.where(np.isinf(hi), s * 2, (lo + hi) / 2)
    s = np.maximum(s, 1e-3 * np.maximum(d.mean(axis=1), 1e-12))
    return np.exp(-over / s[:, None])


def _weighted(near: DataFrame) -> DataFrame:
    """near: cell_id, other, d. Adds w, by row."""

    @F.pandas_udf("array<double>")
    def weights(d: pd.Series) -> pd.Series:
        size, out = d.map(len).to_numpy(), np.empty(len(d), object)
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            out[at] = list(map(list, smooth_weights(np.array(d.iloc[at].tolist(), float))))
        return pd.Series(out)

    rows = near.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("p"))  # k neighbours a row
    rows = rows.withColumn("w", weights(F.transform("p", lambda x: x["d"])))
    return rows.select("cell_id", F.explode(F.arrays_zip("p", "w")).alias("x")).select("cell_id", F.col("x.p.other").alias("other"), F.col("x.p.d").alias("d"), F.col("x.w").alias("w"))


def fuzzy_graph(emb: DataFrame, k: int = 15) -> DataFrame:
    """cell_id_a < cell_id_b, weight: the fuzzy union u + v - uv of the two directions' weights."""
    w = _weighted(nearest(emb, k)).select(F.least("cell_id", "other").alias("cell_id_a"), F.greatest("cell_id", "other").alias("cell_id_b"), "w")
    union = F.sum("w") - F.when(F.count(F.lit(1)) == 2, F.product("w")).otherwise(0.0)
    return w.groupBy("cell_id_a", "cell_id_b").agg(union.alias("weight"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b), fitted by least squares to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p, damp = np.zeros(2), 1e-2  # logarithms of a and b
    cost = lambda q: ((1 / (1 + np.exp(q[0]) * d ** (2 * np.exp(q[1]))) - want) ** 2).sum()
    for _ in range(200):
        a, b = np.exp(p)
        f = 1 / (1 + a * d ** (2 * b))
        jac = np.stack([-f * (1 - f), -f * (1 - f) * 2 * b * np.log(d)], axis=1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), jac.T @ (want - f))
        if cost(p + step) < cost(p):
            p, damp = p + step, damp / 3
        else:
            damp *= 3
    return tuple(np.exp(p))


def _start(x: np.ndarray, rng) -> np.ndarray:
    """The two leading principal components, scaled, with a little noise."""
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    y = np.zeros((len(x), 2))
    y[:, : min(2, len(s))] = u[:, :2] * s[:2]
    y *= np.sign(y[np.abs(y).argmax(axis=0), [0, 1]] + 1e-300)
    return y / max(np.abs(y).max(), 1e-12) + rng.normal(0, 1e-4, y.shape)


def _place(emb: DataFrame, fit: DataFrame, layout: DataFrame, k: int) -> DataFrame:
    """layout (cell_id, x, y of fit's rows) and the other rows of emb, at the weighted mean of their k nearest fitted rows."""
    rest = emb.select("cell_id", "v").join(fit.select("cell_id"), "cell_id", "left_anti")
    near = _weighted(nearest(checkpointed(rest), k, fit.select("cell_id", "v"))).join(layout.select(F.col("cell_id").alias("other"), "x", "y"), "other")
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
    return layout.union(near.groupBy("cell_id").agg(mean("x"), mean("y")))


def _laid_out(emb: DataFrame, n_fit: int, k: int, kernel) -> DataFrame:
    emb = emb.select("cell_id", "v").where("cell_id is not null and v is not null")
    fit = checkpointed(subsample(emb, n_fit))
    ids, x = matrix(fit)
    kind = emb.schema["cell_id"].dataType.simpleString()
    at = np.zeros((len(ids), 2)) if len(ids) < 3 else kernel(fit, ids, x)
    layout = emb.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, at, strict=True)], f"cell_id {kind}, x double, y double")
    return layout if emb.limit(n_fit + 1).count() <= n_fit else _place(emb, fit, layout, min(k, len(ids)))


def umap(emb: DataFrame, n_neighbors: int = 15, min_dist: float = 0.5, n_epochs: int | None = None, n_fit: int = DRIVER_ROWS, negatives: int = 5, seed: int = 42) -> DataFrame:
    """cell_id, x, y. Cross-entropy layout of the fuzzy neighbour graph by stochastic gradient steps, started from the principal components.
    Up to n_fit rows are laid out, the others placed among them. Rows with a null id or vector are left out; under three rows all lie at 0."""
    if n_fit > DRIVER_ROWS:
        raise ValueError(f"n_fit is at most {DRIVER_ROWS}")

    def kernel(fit: DataFrame, ids: list, x: np.ndarray) -> np.ndarray:
        index = {c: i for i, c in enumerate(ids)}
        edges = fuzzy_graph(fit, min(n_neighbors, len(ids) - 1)).orderBy("cell_id_a", "cell_id_b").toPandas()
        a, b, w = edges["cell_id_a"].map(index).to_numpy(), edges["cell_id_b"].map(index).to_numpy(), edges["weight"].to_numpy()
        rng, (ca, cb) = np.random.default_rng(seed), curve(min_dist)
        y = 10 * _start(x, rng)
        epochs = n_epochs or (500 if len(ids) <= 10_000 else 200)
        chance = w / w.max()

        def push(at, other, attract):
            diff = y[at] - y[other]
            d2 = (diff * diff).sum(axis=1)
            if attract:
                g = np.where(d2 > 0, -2 * ca * cb * np.maximum(d2, 1e-12) ** (cb - 1) / (1 + ca * d2**cb), 0)
            else:
                g = np.where(at != other, 2 * cb / ((0.001 + d2) * (1 + ca * d2**cb)), 0)
            return np.clip(g[:, None] * diff, -4, 4)

        for epoch in range(epochs):
            rate = 1 - epoch / epochs
            live = rng.random(len(w)) < chance
            p, q = np.concatenate([a[live], b[live]]), np.concatenate([b[live], a[live]])
            move = push(p, q, True)
            far_p, far_q = np.repeat(p, negatives), rng.integers(0, len(y), len(p) * negatives)
            away = push(far_p, far_q, False)
            for c in range(2):
                # steps of one epoch are taken together; the mean over a point's edges keeps hubs steady. All pushes on a point at the rim of a dense start
                # go one way, where one after the other would fade: the whole move is clipped as a single step is
                total = np.bincount(p, move[:, c], len(y)) + np.bincount(far_p, away[:, c], len(y))
                n = np.bincount(p, minlength=len(y))
                y[:, c] += rate * np.clip(total / np.maximum(n, 1) * np.minimum(n, 4), -4, 4)
        return y

    return _laid_out(emb, n_fit, n_neighbors, kernel)


def tsne(emb: DataFrame, perplexity: float = 30.0, n_iter: int = 500, n_fit: int = TSNE_ROWS, seed: int = 42) -> DataFrame:
    """cell_id, x, y. Exact t-SNE (all pairs) of up to n_fit rows, the others placed among them; rows as for umap. A perplexity beyond a third
    of the rows is lowered to that."""
    if n_fit > TSNE_ROWS:
        raise ValueError(f"n_fit is at most {TSNE_ROWS}")

    def kernel(fit: DataFrame, ids: list, x: np.ndarray) -> np.ndarray:
        n = len(x)
        sq = (x * x).sum(axis=1)
        d = np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0)
        np.fill_diagonal(d, np.inf)
        d -= d.min(axis=1, keepdims=True)
        want = np.log(max(1.0, min(perplexity, (n - 1) / 3)))
        lo, hi, beta = np.zeros(n), np.full(n, np.inf), 1 / np.maximum(np.where(np.isfinite(d), d, 0).mean(axis=1), 1e-12)
        for _ in range(50):
            p = np.exp(-d * beta[:, None])
            p /= p.sum(axis=1, keepdims=True)
            entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
            wide = entropy > want
            lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
            beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
        p = np.maximum((p + p.T) / (2 * n), 1e-12).astype(np.float32)
        rng = np.random.default_rng(seed)
        y = (1e-2 * _start(x, rng)).astype(np.float32)
        speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50)
        for step in range(n_iter):
            early = step < n_iter // 4
            sq = (y * y).sum(axis=1)
            q = 1 / (1 + np.maximum(sq[:, None] + sq - 2 * y @ y.T, 0))
            np.fill_diagonal(q, 0)
            f = ((12 if early else 1) * p - q / q.sum()) * q
            grad = 4 * (f.sum(axis=1)[:, None] * y - f @ y)
            gain = np.maximum(np.where(np.sign(grad) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
            speed = (0.5 if early else 0.8) * speed - rate * gain * grad
            y = y + speed
            y -= y.mean(axis=0)
        return y

    return _laid_out(emb, n_fit, max(2, int(3 * perplexity)), kernel)
