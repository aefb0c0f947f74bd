"""A variational autoencoder of counts with batches: latent vectors free of batch effects, denoised expression.

Encoder and decoder have one hidden layer; counts are negative binomial around library size times decoded shares, each gene's dispersion
settled by moments. The model is fitted on the driver over at most n_fit cells, chosen by seeded hash; all cells are then encoded and
decoded where they lie. Its size goes with genes and batches, not cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.sources.catalog import checkpointed

FIT_CELLS = 5000
#: Kinds of batch at most: the model has a column for each.
MAX_BATCHES = 1000
#: Cells encoded at once.
ROWS = 256


class Vae:
    def __init__(self, n_genes: int, n_batches: int, n_latent: int = 30, n_hidden: int = 64, seed: int = 42):
        self.rng = np.random.default_rng(seed)
        layer = lambda a, b: self.rng.normal(0, np.sqrt(2 / (a + b)), (a, b))
        s = n_batches
        self.p = {
            "w1": layer(n_genes + s, n_hidden), "b1": np.zeros(n_hidden), "wm": layer(n_hidden, n_latent), "bm": np.zeros(n_latent), "wv": 0.1 * layer(n_hidden, n_latent), "bv": np.zeros(n_latent) - 2,
            "w2": layer(n_latent + s, n_hidden), "b2": np.zeros(n_hidden), "w3": layer(n_hidden + s, n_genes), "b3": np.zeros(n_genes),
        }
        self.theta = np.full(n_genes, 10.0)

    def encode(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        h = np.maximum(np.concatenate([np.log1p(x), s], axis=1) @ self.p["w1"] + self.p["b1"], 0)
        return h @ self.p["wm"] + self.p["bm"]

    def decode(self, z: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Shares of each gene, summing to one."""
        g = np.maximum(np.concatenate([z, s], axis=1) @ self.p["w2"] + self.p["b2"], 0)
        logits = np.concatenate([g, s], axis=1) @ self.p["w3"] + self.p["b3"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def loss(self, x: np.ndarray, s: np.ndarray, noise: np.ndarray, weight: float = 1.0) -> tuple[float, dict]:
        """Negative evidence bound a cell (less terms without parameters) and its gradients."""
        p, n = self.p, len(x)
        size = np.maximum(x.sum(axis=1, keepdims=True), 1)
        xs = np.concatenate([np.log1p(x), s], axis=1)
        h = np.maximum(xs @ p["w1"] + p["b1"], 0)
        mu, lv = h @ p["wm"] + p["bm"], h @ p["wv"] + p["bv"]
        sd = np.exp(lv / 2)
        zs = np.concatenate([mu + sd * noise, s], axis=1)
        g = np.maximum(zs @ p["w2"] + p["b2"], 0)
        gs = np.concatenate([g, s], axis=1)
        logits = gs @ p["w3"] + p["b3"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        rho = e / e.sum(axis=1, keepdims=True)
        m = size * rho + 1e-8
        value = -(x * np.log(m) - (x + self.theta) * np.log(m + self.theta)).sum() / n + weight * 0.5 * (mu * mu + np.exp(lv) - lv - 1).sum() / n
        d = -(x / m - (x + self.theta) / (m + self.theta)) * size / n
        d = rho * (d - (rho * d).sum(axis=1, keepdims=True))
        out = {"w3": gs.T @ d, "b3": d.sum(axis=0)}
        d = (d @ p["w3"].T)[:, : g.shape[1]] * (g > 0)
        out |= {"w2": zs.T @ d, "b2": d.sum(axis=0)}
        d = (d @ p["w2"].T)[:, : mu.shape[1]]
        dm, dv = d + weight * mu / n, d * noise * sd / 2 + weight * 0.5 * (np.exp(lv) - 1) / n
        out |= {"wm": h.T @ dm, "bm": dm.sum(axis=0), "wv": h.T @ dv, "bv": dv.sum(axis=0)}
        d = (dm @ p["wm"].T + dv @ p["wv"].T) * (h > 0)
        return value, out | {"w1": xs.T @ d, "b1": d.sum(axis=0)}

    def fit(self, x: np.ndarray, s: np.ndarray, n_epochs: int = 400, size: int = 128, rate: float = 2e-3) -> Vae:
        mean, var = x.mean(axis=0), x.var(axis=0)
        self.theta = np.clip(mean**2 / np.maximum(var - mean, 1e-9), 0.1, 1e3)
        self.p["b3"] = np.log((mean + 1e-4) / (mean + 1e-4).sum())
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(n_epochs):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), size):
                b = order[at : at + size]
                _, grad = self.loss(x[b], s[b], self.rng.normal(size=(len(b), len(self.p["bm"]))), min(1.0, 2 * (epoch + 1) / n_epochs))
                step += 1
                norm = np.sqrt(sum((v * v).sum() for v in grad.values()))
                for k, v in grad.items():
                    v = v * min(1.0, 100 / max(norm, 1e-12))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] = self.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _dense(lists: pd.Series, n: int) -> np.ndarray:
    out = np.zeros((len(lists), n))
    for k, pairs in enumerate(lists):
        for p in pairs if pairs is not None else ():
            out[k, p["g"]] += p["x"]
    return out


def _one_hot(batch: pd.Series, n: int) -> np.ndarray:
    return np.eye(n)[batch.to_numpy(int)]


def vae_batch(expr: DataFrame, batches_of: DataFrame | None = None, n_latent: int = 30, n_epochs: int = 400, n_hidden: int = 64, n_fit: int = FIT_CELLS, library: float = 1e4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """expr: cell, gene, value (counts); batches_of: cell, batch, once a cell. Returns latent (cell, v) and denoised (cell, gene, value: shares times
    library, decoded with the cell's own batch). Without batches_of all cells are one batch. Cells of batches_of without counts are encoded as
    zeros; cells without a batch (null or absent) are left out, as are null genes and values. No cells or no genes: two empty tables."""
    expr = expr.where("cell is not null and gene is not null and value is not null")
    if batches_of is None:
        batches_of = expr.select("cell").distinct().withColumn("batch", F.lit(0))
    batches_of = batches_of.select("cell", "batch").where("cell is not null and batch is not null")
    kinds = sorted(r[0] for r in batches_of.select("batch").distinct().limit(MAX_BATCHES + 1).collect())
    if len(kinds) > MAX_BATCHES:
        raise ValueError(f"more than {MAX_BATCHES} batches")
    spark, kind = expr.sparkSession, expr.schema["cell"].dataType.simpleString()
    genes = sorted(r.gene for r in expr.select("gene").distinct().collect())  # a row a gene
    latent_type, denoised_type = f"cell {kind}, v array<double>", f"cell {kind}, gene {expr.schema['gene'].dataType.simpleString()}, value double"
    if not kinds or not genes:
        return spark.createDataFrame([], latent_type), spark.createDataFrame([], denoised_type)
    number = spark.createDataFrame(list(enumerate(genes)), f"g int, gene {expr.schema['gene'].dataType.simpleString()}")
    which = spark.createDataFrame(list(enumerate(kinds)), f"b int, batch {batches_of.schema['batch'].dataType.simpleString()}")
    rows = expr.join(F.broadcast(number), "gene").groupBy("cell").agg(F.collect_list(F.struct("g", F.col("value").cast("double").alias("x"))).alias("x"))  # at most a pair a gene
    rows = checkpointed(batches_of.join(F.broadcast(which), "batch").select("cell", "b").join(rows, "cell", "left").select("cell", "b", "x"))
    part = rows.orderBy(F.xxhash64(F.lit(seed), "cell"), "cell").limit(n_fit).toPandas()
    n, m = len(genes), len(kinds)
    model = Vae(n, m, n_latent, n_hidden, seed).fit(_dense(part["x"], n), _one_hot(part["b"], m), n_epochs)

    def encoded(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.iloc[at : at + ROWS]
                s = _one_hot(b["b"], m)
                yield b["cell"].to_numpy(), s, model.encode(_dense(b["x"], n), s)

    def latent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell, _, z in encoded(batches):
            yield pd.DataFrame({"cell": cell, "v": list(z)})

    def denoised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(genes, object)
        for cell, s, z in encoded(batches):
            yield pd.DataFrame({"cell": np.repeat(cell, n), "gene": np.tile(names, len(cell)), "value": (library * model.decode(z, s)).ravel()})

    return rows.mapInPandas(latent, latent_type), rows.mapInPandas(denoised, denoised_type)


def vae_impute(expr: DataFrame, batches_of: DataFrame | None = None, **options) -> DataFrame:
    """The denoised table of vae_batch."""
    return vae_batch(expr, batches_of, **options)[1]
