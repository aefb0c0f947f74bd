"""Spatial graphs and what is counted on them.

Points lie on a grid of tiles: neighbours meet by an equi-join on the tile, one side replicated to the 3 x 3 tiles around. Edges are
(cell_id_a, cell_id_b, distance) with a < b, each once. Nearest neighbours meet in tiles of even counts, compared in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histomesh.sources.catalog import checkpointed

NEAREST = 1e-10


def _tiled(points: DataFrame, width: float, around: bool) -> DataFrame:
    tx, ty = F.floor(F.col("x") / width), F.floor(F.col("y") / width)
    if not around:
        return points.withColumns({"tx": tx, "ty": ty})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return points.withColumn("s", F.explode(steps)).withColumns({"tx": tx + F.col("s.i"), "ty": ty + F.col("s.j")}).drop("s")


def close_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs within radius (included): a < b by id, d."""
    left = _tiled(points.select("cell_id", "x", "y"), radius, False).withColumnsRenamed({"cell_id": "a", "x": "xa", "y": "ya"})
    right = _tiled(points.select("cell_id", "x", "y"), radius, True).withColumnsRenamed({"cell_id": "b", "x": "xb", "y": "yb"})
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return left.join(right, ["tx", "ty"]).where("a < b").select("a", "b", d.alias("d")).where(F.col("d") <= radius)


def radius_graph(points: DataFrame, radius: float) -> DataFrame:
    if radius <= 0:
        raise ValueError("radius must be positive")
    return close_pairs(points, radius).select(F.col("a").alias("cell_id_a"), F.col("b").alias("cell_id_b"), F.greatest("d", F.lit(NEAREST)).alias("distance"))


#: Points of a tile, about, in nearest-neighbour search, and at least for each neighbour asked for; queries whose distances are held at once.
TILE, EACH, CHUNK = 2048, 8, 256


class Cuts:
    """Tiles of about as many points each: strips of even counts along x, and within each of even counts along y. by: the groups' column, or None."""

    def __init__(self, points: DataFrame, by: str | None, cap: int):
        g = (F.col(by).cast("string") if by else F.lit("all")).alias("g")
        rows = points.select(g, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        counts = dict(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a group
        strips = {k: max(1, math.ceil(math.sqrt(n / cap))) for k, n in counts.items()}
        most = max(strips.values(), default=1)
        self.x = {k: np.zeros(0) for k in counts}
        self.y = {k: [np.zeros(0)] for k in counts}
        if most > 1:
            shares = F.array(*[F.lit(j / most) for j in range(1, most)])
            found = rows.groupBy("g").agg(F.percentile_approx("x", shares, F.lit(10_000)).alias("cuts")).collect()
            self.x = {r.g: self._thinned(r.cuts, most, strips[r.g]) for r in found}

            def strip(batches: Iterator[pd.DataFrame], cuts=self.x) -> Iterator[pd.DataFrame]:
                for b in batches:
                    out = np.zeros(len(b), np.int64)
                    for k in b["g"].unique():
                        at = (b["g"] == k).to_numpy()
                        out[at] = np.searchsorted(cuts[k], b["x"].to_numpy()[at], "right")
                    yield b.assign(s=out)[["g", "s", "y"]]

            found = rows.mapInPandas(strip, "g string, s long, y double").groupBy("g", "s").agg(F.percentile_approx("y", shares, F.lit(10_000)).alias("cuts")).collect()  # a row a strip
            self.y = {k: [np.zeros(0)] * (len(v) + 1) for k, v in self.x.items()}
            for r in found:
                self.y[r.g][r.s] = self._thinned(r.cuts, most, strips[r.g])
        self.first, at = {}, 0
        for k in sorted(counts):
            n = np.array([len(c) + 1 for c in self.y[k]])
            self.first[k] = at + np.cumsum(n) - n
            at += int(n.sum())
        self.tiles = at

    @staticmethod
    def _thinned(cuts: list, most: int, strips: int) -> np.ndarray:
        return np.unique(np.array(cuts, float)[[-(-j * most // strips) - 1 for j in range(1, strips)]])

    def home(self, k: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.x[k], x, "right")
        out = np.empty(len(x), np.int64)
        for i in np.unique(s).tolist():
            at = s == i
            out[at] = self.first[k][i] + np.searchsorted(self.y[k][i], y[at], "right")
        return out

    def around(self, k: str, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) of every tile that the box of half width r around a point meets."""
        lo, hi = np.searchsorted(self.x[k], x - r, "left"), np.searchsorted(self.x[k], x + r, "right")
        rows, tiles = [], []
        for i in range(len(self.y[k])):
            at = np.flatnonzero((lo <= i) & (i <= hi))
            if len(at):
                a, b = np.searchsorted(self.y[k][i], y[at] - r[at], "left"), np.searchsorted(self.y[k][i], y[at] + r[at], "right")
                n = b - a + 1
                rows.append(np.repeat(at, n))
                tiles.append(self.first[k][i] + np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum()))
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *tiles])


def _least(q: pd.DataFrame, p: pd.DataFrame, k: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, d) of the k nearest points of each query, nearest first, ties by id; p in order of id. q may have a column r: nothing beyond it."""
    qx, qy, px, py = (f[c].to_numpy(float) for f in (q, p) for c in ("x", "y"))
    ids = p["cell_id"].to_numpy()
    bound = q["r"].to_numpy(float) if "r" in q else np.full(len(q), np.inf)
    out = [], [], []
    for at in range(0, len(q), CHUNK):
        s = slice(at, at + CHUNK)
        d = np.sqrt((qx[s, None] - px) ** 2 + (qy[s, None] - py) ** 2)
        if own:
            d[q["qid"].to_numpy()[s, None] == ids[None]] = np.inf
        top = np.minimum(bound[s], np.partition(d, k - 1, axis=1)[:, k - 1]) if d.shape[1] > k else bound[s]
        row, col = np.nonzero((d <= top[:, None]) & np.isfinite(d))
        v = d[row, col]
        order = np.lexsort((col, v, row))
        row, col, v = row[order], col[order], v[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = place < k
        for x, y in zip(out, (row[keep] + at, col[keep], v[keep]), strict=True):
            x.append(y)
    return tuple(np.concatenate([np.zeros(0, np.int64 if i < 2 else float), *x]) for i, x in enumerate(out))


def nearest(queries: DataFrame, points: DataFrame, k: int, by: str | None = None, own: bool = True) -> DataFrame:
    """qid, cell_id, d (and by) of the k nearest points (fewer if there are no more); ties by id. queries: qid, x, y. own: not the query itself. by: only
    points of the query's group, all groups at once.

    Tiles of about TILE points: each query first looks at its own tile, which gives it a bound, and then, within that bound, at the other tiles that the
    bound reaches. So no tile is denser than others, and two searches are all."""
    cuts = Cuts(points, by, max(TILE, EACH * k))
    kind, qkind = points.schema["cell_id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    group = (F.col(by).cast("string") if by else F.lit("all")).alias("g")

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("g", sort=False):
                if g in cuts.first:
                    yield part.assign(t=cuts.home(g, part["x"].to_numpy(float), part["y"].to_numpy(float)))

    asked = queries.select(group, "qid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(at_home, f"g string, qid {qkind}, x double, y double, t long")
    held = points.select(group, "cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(at_home, f"g string, cell_id {kind}, x double, y double, t long")
    held = checkpointed(held)

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("cell_id", kind="stable")
        row, col, d = _least(q, p, k, own)
        cols = {c: q[c].to_numpy()[row] for c in ("g", "qid", "x", "y", "t")}
        return pd.DataFrame(cols | {"cell_id": p["cell_id"].to_numpy()[col], "d": d})

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("g", sort=False):
                row, tile = cuts.around(g, part["x"].to_numpy(float), part["y"].to_numpy(float), part["r"].to_numpy(float))
                part = part.iloc[row].assign(to=tile)
                yield part[part["to"] != part["t"]][["g", "qid", "x", "y", "t", "r", "to"]]

    cols = f"g string, qid {qkind}, x double, y double, t long, cell_id {kind}, d double"
    near = checkpointed(asked.groupBy("t").cogroup(held.groupBy("t")).applyInPandas(search, cols))
    bound = asked.join(near.groupBy("g", "qid").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")), ["g", "qid"], "left").withColumn("r", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")))
    reach = checkpointed(bound.select("g", "qid", "x", "y", "t", "r").mapInPandas(further, f"g string, qid {qkind}, x double, y double, t long, r double, to long"))
    more = reach.groupBy("to").cogroup(held.groupBy("t")).applyInPandas(search, cols)
    out = ["g", "qid", "cell_id", "d"]
    open_ = reach.select("g", "qid").distinct()
    merged = near.join(open_, ["g", "qid"], "left_semi").select(*out).union(more.select(*out))
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("g", "qid").orderBy("d", "cell_id"))).where(F.col("rank") <= k).select(*out)
    done = near.join(open_, ["g", "qid"], "left_anti").select(*out).union(merged)
    return done.select(*([F.col("g").alias(by)] if by else []), "qid", "cell_id", "d")


def knn_graph(points: DataFrame, k: int = 10) -> DataFrame:
    near = nearest(points.select(F.col("cell_id").alias("qid"), "x", "y"), points, k)
    return near.groupBy(F.least("qid", "cell_id").alias("cell_id_a"), F.greatest("qid", "cell_id").alias("cell_id_b")).agg(F.greatest(F.min("d"), F.lit(NEAREST)).alias("distance"))


def both_ways(edges: DataFrame) -> DataFrame:
    """cell_id, other, distance: every edge seen from either end."""
    a = edges.select(F.col("cell_id_a").alias("cell_id"), F.col("cell_id_b").alias("other"), "distance")
    return a.union(edges.select(F.col("cell_id_b").alias("cell_id"), F.col("cell_id_a").alias("other"), "distance"))


def neighbour_weights(edges: DataFrame, clusters: DataFrame, weighted: bool = False) -> DataFrame:
    """cell_id, cluster, w: labelled neighbours by cluster (with weighted, the sum of inverse distances)."""
    w = 1 / F.greatest("distance", F.lit(NEAREST)) if weighted else F.lit(1.0)
    return both_ways(edges).join(clusters.select(F.col("cell_id").alias("other"), "cluster"), "other").groupBy("cell_id", "cluster").agg(F.sum(w).alias("w"))


def composition(edges: DataFrame, clusters: DataFrame, weighted: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """A row a graph node (or a row of cells), a column a cluster in order of its text: neighbours of the cluster."""
    names = sorted(r[0] for r in clusters.select(F.col("cluster").cast("string")).distinct().collect())  # clusters are few
    wide = neighbour_weights(edges, clusters, weighted).groupBy("cell_id").pivot("cluster", names).agg(F.sum("w"))
    nodes = cells.select("cell_id") if cells is not None else both_ways(edges).select("cell_id").distinct()
    return nodes.join(wide, "cell_id", "left").na.fill(0.0, names)


def diversity(edges: DataFrame, clusters: DataFrame, weighted: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """cell_id, shannon, simpson of the neighbours' clusters; 0 without labelled neighbours."""
    w = neighbour_weights(edges, clusters, weighted)
    p = w.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("cell_id")))
    out = p.groupBy("cell_id").agg(F.greatest(F.lit(0.0), -F.sum(F.col("p") * F.log(F.col("p") + 1e-15))).alias("shannon"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"))
    nodes = cells.select("cell_id") if cells is not None else both_ways(edges).select("cell_id").distinct()
    return nodes.join(out, "cell_id", "left").na.fill(0.0, ["shannon", "simpson"])


def nth_order(edges: DataFrame, order: int = 2, cells: DataFrame | None = None) -> DataFrame:
    """cell_id, n_order_1.. n_order_k: nodes at exactly so many hops."""
    step = both_ways(edges).select("cell_id", "other").distinct()
    nodes = step.select("cell_id").distinct()
    front = step
    seen = nodes.select("cell_id", F.col("cell_id").alias("other")).union(front)
    out = (cells if cells is not None else nodes).select("cell_id")
    for n in range(1, order + 1):
        out = out.join(front.groupBy("cell_id").agg(F.count(F.lit(1)).alias(f"n_order_{n}")), "cell_id", "left")
        if n < order:
            further = front.join(step.select(F.col("cell_id").alias("other"), F.col("other").alias("next")), "other").select("cell_id", F.col("next").alias("other")).distinct()
            front = checkpointed(further.join(seen, ["cell_id", "other"], "left_anti"))
            seen = seen.union(front)
    return out.na.fill(0)


def label_pairs(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_a <= cluster_b (as text), n: edges with both ends labelled."""
    one = lambda c, name: clusters.select(F.col("cell_id").alias(c), F.col("cluster").cast("string").alias(name))
    both = edges.join(one("cell_id_a", "la"), "cell_id_a").join(one("cell_id_b", "lb"), "cell_id_b")
    return both.groupBy(F.least("la", "lb").alias("cluster_a"), F.greatest("la", "lb").alias("cluster_b")).agg(F.count(F.lit(1)).alias("n"))


def colocalization(edges: DataFrame, clusters: DataFrame, e: int | None = None) -> DataFrame:
    """observed and expected edges of every pair of clusters, ratio, log2_ratio (NaN for ratio 0). Expected: over all edges, or e."""
    sizes = clusters.groupBy(F.col("cluster").cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return ratios(sizes, label_pairs(edges, clusters), edges.agg(F.count(F.lit(1)).alias("edges_all")) if e is None else sizes.agg(F.lit(e).alias("edges_all")))


def ratios(sizes: DataFrame, pairs: DataFrame, edges_all: DataFrame) -> DataFrame:
    """colocalization() of c, n (cells of each cluster), cluster_a, cluster_b, n (edges of each pair) and edges_all (one row)."""
    a, b = sizes.select(F.col("c").alias("cluster_a"), F.col("n").alias("na")), sizes.select(F.col("c").alias("cluster_b"), F.col("n").alias("nb"))
    whole = sizes.agg(F.sum("n").alias("cells_all")).crossJoin(F.broadcast(edges_all))
    grid = a.join(b, F.col("cluster_a") <= F.col("cluster_b")).crossJoin(F.broadcast(whole))  # clusters squared
    grid = grid.join(pairs, ["cluster_a", "cluster_b"], "left").withColumn("observed", F.coalesce("n", F.lit(0)).cast("long"))
    ways = F.when(F.col("cluster_a") == F.col("cluster_b"), F.col("na") * (F.col("na") - 1)).otherwise(2 * F.col("na") * F.col("nb"))
    grid = grid.withColumn("expected", ways.cast("double") * F.col("edges_all") / F.greatest(F.col("cells_all") * (F.col("cells_all") - 1), F.lit(1)))
    ratio = F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).otherwise(0.0)
    grid = grid.withColumn("ratio", ratio).withColumn("log2_ratio", F.when(F.col("ratio") > 0, F.log2("ratio")).otherwise(F.lit(float("nan"))))
    return grid.select("cluster_a", "cluster_b", "observed", "expected", "ratio", "log2_ratio")


def border_enrichment(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Share of each cluster's cells that touch another cluster, over the share expected of a random labelling at the mean degree."""
    own = clusters.select("cell_id", F.col("cluster").alias("own"))
    touch = both_ways(edges).join(clusters.select(F.col("cell_id").alias("other"), F.col("cluster").alias("theirs")), "other").join(own, "cell_id").where("own <> theirs").select("cell_id").distinct().withColumn("border", F.lit(1))
    per = clusters.join(touch, "cell_id", "left").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"), F.count("border").alias("n_border"))
    return enrichment(per, clusters.agg(F.count(F.lit(1)).alias("N")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("E")))))  # one row


def enrichment(per: DataFrame, whole: DataFrame) -> DataFrame:
    """border_enrichment() of cluster, n_cells, n_border and of N, E (cells and edges, one row)."""
    per = per.crossJoin(F.broadcast(whole)).withColumn("border_fraction", F.col("n_border") / F.col("n_cells"))
    degree = 2 * F.col("E") / F.greatest("N", F.lit(1))
    per = per.withColumn("chance", F.when(degree > 0, 1 - F.pow(F.col("n_cells") / F.greatest("N", F.lit(1)), degree)).otherwise(0.0))
    return per.select("cluster", "n_cells", "n_border", "border_fraction", F.when(F.col("chance") > 0, F.col("border_fraction") / F.col("chance")).otherwise(0.0).alias("enrichment"))


def clustering_coefficient(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Closed share of each cell's pairs of neighbours; 0 below two neighbours. Triangles are counted once, along edges from lower to higher degree, so
    that hubs don't pair up their neighbours: an edge's triangles are what its ends' lists of higher neighbours have in common."""
    edges = checkpointed(edges.select("cell_id_a", "cell_id_b", "distance"))
    degree = checkpointed(both_ways(edges).groupBy("cell_id").agg(F.count(F.lit(1)).alias("degree")))
    da, db = (degree.select(F.col("cell_id").alias(f"cell_id_{s}"), F.col("degree").alias(f"d{s}")) for s in "ab")
    up = edges.join(da, "cell_id_a").join(db, "cell_id_b")
    first = F.struct("da", "cell_id_a") < F.struct("db", "cell_id_b")
    up = checkpointed(up.select(F.when(first, F.col("cell_id_a")).otherwise(F.col("cell_id_b")).alias("u"), F.when(first, F.col("cell_id_b")).otherwise(F.col("cell_id_a")).alias("v")))
    lists = up.groupBy("u").agg(F.collect_list("v").alias("vs"))  # of higher degree: at most the root of twice the edges
    both = up.join(lists, "u").join(lists.select(F.col("u").alias("v"), F.col("vs").alias("ws")), "v").select("u", "v", F.array_intersect("vs", "ws").alias("w")).where("size(w) > 0")
    corners = both.select(F.explode(F.concat(F.array(F.struct(F.col("u").alias("cell_id"), F.size("w").alias("n")), F.struct(F.col("v").alias("cell_id"), F.size("w").alias("n"))), F.transform("w", lambda x: F.struct(x.alias("cell_id"), F.lit(1).alias("n"))))).alias("c"))
    corners = corners.groupBy("c.cell_id").agg(F.sum("c.n").alias("t"))
    out = cells.select("cell_id").join(degree, "cell_id", "left").join(corners, "cell_id", "left")
    return out.select("cell_id", F.when(F.col("degree") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering_coeff"))
