"""Point patterns: Ripley's K, L, G, F, Clark-Evans, quadrats, permutation tests, envelopes. points: cell_id, x, y, cluster."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histomesh.functions.mathx import chi2_sf, two_sided
from histomesh.operators import near as nr
from histomesh.operators.graphs import CHUNK, TILE, Cuts, nearest, ratios
from histomesh.operators.near import within
from histomesh.sources.catalog import checkpointed

TINY = 1e-10


def areas(points: DataFrame) -> DataFrame:
    """Per cluster: n, area of the bounding box, and its sides."""
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.greatest(wide * high, F.lit(TINY)).alias("area"), wide.alias("wide"), high.alias("high"))


def radii(points: DataFrame, n_radii: int = 50, max_radius: float | None = None) -> DataFrame:
    """cluster, n, area, j, r: n_radii even steps up to max_radius, or a quarter of the box's shorter side. Clusters of one point have none."""
    top = F.lit(float(max_radius)) if max_radius else F.least("wide", "high") / 4
    steps = areas(points).where("n > 1").select("cluster", "n", "area", top.alias("top"), F.explode(F.sequence(F.lit(1), F.lit(n_radii))).alias("j"))
    return steps.withColumn("r", F.col("top") * F.col("j") / n_radii)


def together(points: DataFrame) -> DataFrame:
    """points as one cluster "all"."""
    return points.withColumn("cluster", F.lit("all"))


def ripley_k(points: DataFrame, n_radii: int = 50, max_radius: float | None = None) -> DataFrame:
    """cluster, r, K, K_theo: A / (n (n - 1)) times the ordered pairs within r, without edge correction. All clusters at once, in tiles of even counts;
    two tiles meet if their boxes lie within the largest radius, and pairs are counted by radius step at once (a pair of boxes whose least and largest
    distance lie in one step without looking at points)."""
    steps = radii(points, n_radii, max_radius)
    tops = {str(r.cluster): float(r.top) for r in steps.select("cluster", "top").distinct().collect() if r.top > 0}  # a row a cluster
    cuts = Cuts(points, "cluster", TILE)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("g", sort=False):
                if g in tops:
                    yield part.assign(t=cuts.home(g, part["x"].to_numpy(float), part["y"].to_numpy(float)))

    rows = points.select(F.col("cluster").cast("string").alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    tiled = checkpointed(rows.mapInPandas(dealt, "g string, x double, y double, t long"))
    boxes = tiled.groupBy("g", "t").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    top = points.sparkSession.createDataFrame(list(tops.items()) or [("", 0.0)], "g string, top double")
    boxes = boxes.join(F.broadcast(top), "g")  # a row a cluster
    a, b = (boxes.select("g", "top", *[F.col(c).alias(f"{c}{s}") for c in ("t", "x0", "x1", "y0", "y1", "n")]) for s in "ab")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0a") - F.col(f"{c}1b"), F.col(f"{c}0b") - F.col(f"{c}1a"))
    span = lambda c: F.greatest(F.col(f"{c}1a") - F.col(f"{c}0b"), F.col(f"{c}1b") - F.col(f"{c}0a"))
    step_of = lambda d: F.least(F.lit(n_radii), F.greatest(F.lit(1), F.ceil(d / F.col("top") * n_radii - 1e-9))).cast("int")
    meet = a.join(b.drop("top"), "g").where("ta <= tb").withColumns({"near": F.hypot(gap("x"), gap("y")), "far": F.hypot(span("x"), span("y"))}).where("near <= top")
    one = (F.col("ta") != F.col("tb")) & (F.col("far") <= F.col("top")) & (step_of(F.col("near")) == step_of(F.col("far")))
    meet = checkpointed(meet.select("g", "ta", "tb", "top", "na", "nb", one.alias("one"), step_of(F.col("far")).alias("i")))
    whole = meet.where("one").select("g", "i", (F.col("na") * F.col("nb")).alias("m"))
    # both tiles' points go to their pair
    sides = meet.where("not one").select("g", "top", F.struct("ta", "tb").alias("pair"), F.explode(F.array(F.struct(F.col("ta").alias("t"), F.lit(0).alias("side")), F.struct(F.col("tb").alias("t"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.where("pair.ta <> pair.tb or s.side = 0").select("g", "top", "pair", "s.t", "s.side")
    sent = sides.join(tiled, ["g", "t"]).select("g", "top", F.col("pair.ta").alias("ta"), F.col("pair.tb").alias("tb"), "side", "x", "y")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        g, limit = rows["g"].iloc[0], float(rows["top"].iloc[0])
        same = rows["ta"].iloc[0] == rows["tb"].iloc[0]
        p, q = ((r["x"].to_numpy(), r["y"].to_numpy()) for r in (rows[rows["side"] == 0], rows[rows["side"] == (0 if same else 1)]))
        m = np.zeros(n_radii + 1, np.int64)
        for at in range(0, len(p[0]), CHUNK):
            d = np.sqrt((p[0][at : at + CHUNK, None] - q[0]) ** 2 + (p[1][at : at + CHUNK, None] - q[1]) ** 2)
            if same:
                d = d[np.arange(d.shape[1])[None] > np.arange(at, at + len(d))[:, None]]
            d = d[d <= limit]
            m += np.bincount(np.clip(np.ceil(d / limit * n_radii - 1e-9), 1, n_radii).astype(int), minlength=n_radii + 1)
        return pd.DataFrame({"g": g, "i": np.arange(1, n_radii + 1, dtype=np.int32), "m": m[1:]})

    counts = whole.union(sent.groupBy("g", "ta", "tb").applyInPandas(count, "g string, i int, m long")).groupBy("g", "i").agg(F.sum("m").alias("m"))
    full = steps.join(counts, (F.coalesce(F.col("cluster").cast("string"), F.lit("")) == F.coalesce("g", F.lit(""))) & (F.col("i") <= F.col("j")), "left").groupBy("cluster", "n", "area", "j", "r").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    return full.select("cluster", "r", (F.col("area") * 2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("K"), (math.pi * F.col("r") * F.col("r")).alias("K_theo"))


def ripley_l(points: DataFrame, **options) -> DataFrame:
    return ripley_k(points, **options).select("cluster", "r", (F.sqrt(F.greatest("K", F.lit(0.0)) / math.pi) - F.col("r")).alias("L"))


def nearest_distances(points: DataFrame) -> DataFrame:
    """cluster, d: each point's distance to the nearest other one of its cluster."""
    kind = points.schema["cluster"].dataType
    return nearest(points.select(F.col("cell_id").alias("qid"), "x", "y", "cluster"), points, 1, by="cluster").select(F.col("cluster").cast(kind), "d")


def _reached(steps: DataFrame, d: DataFrame, name: str) -> DataFrame:
    """Share of distances up to r, with the value under complete randomness."""
    joined = steps.join(d, "cluster").groupBy("cluster", "n", "area", "r").agg(F.avg((F.col("d") <= F.col("r")).cast("double")).alias(name))
    return joined.select("cluster", "r", name, (1 - F.exp(-F.col("n") / F.col("area") * math.pi * F.col("r") * F.col("r"))).alias(f"{name}_theo"))


def ripley_g(points: DataFrame, n_radii: int = 50, max_radius: float | None = None) -> DataFrame:
    """cluster, r, G (share of nearest-neighbour distances up to r), G_theo."""
    return _reached(radii(points, n_radii, max_radius), nearest_distances(points), "G")


def ripley_f(points: DataFrame, n_radii: int = 50, max_radius: float | None = None, n_random: int = 1000, seed: int = 42) -> DataFrame:
    """cluster, r, F (share of n_random uniform points with a point of the cluster within r), F_theo. One random stream across clusters."""
    rng, at = np.random.default_rng(seed), []
    box = points.groupBy("cluster").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).where("n > 1").collect()
    for b in sorted(box, key=lambda b: str(b.cluster)):
        xs, ys = rng.uniform(b.x0, b.x1, n_random), rng.uniform(b.y0, b.y1, n_random)
        at += [(f"random-{k}", float(x), float(y), b.cluster) for k, (x, y) in enumerate(zip(xs, ys, strict=True))]
    kind = points.schema["cluster"].dataType
    asked = points.sparkSession.createDataFrame(at, f"qid string, x double, y double, cluster {kind.simpleString()}")
    out = nearest(asked, points, 1, by="cluster", own=False).select(F.col("cluster").cast(kind), "d")
    return _reached(radii(points, n_radii, max_radius), out, "F")


def clark_evans(points: DataFrame) -> DataFrame:
    """cluster, R, r_observed, r_expected, z_score, p_value; zeros and 1 for a cluster of one point."""
    seen = nearest_distances(points).groupBy("cluster").agg(F.avg("d").alias("seen"))
    rows = areas(points).join(seen, "cluster", "left").withColumn("density", F.col("n") / F.col("area"))
    rows = rows.withColumns({"r_expected": 1 / (2 * F.sqrt("density")), "sd": 0.26136 / F.sqrt(F.col("n") * F.col("density"))})
    z = (F.col("seen") - F.col("r_expected")) / F.col("sd")
    pick = lambda c, v=0.0: F.when(F.col("n") < 2, v).otherwise(c)
    return rows.select("cluster", pick(F.col("seen") / F.col("r_expected")).alias("R"), pick(F.col("seen")).alias("r_observed"), pick(F.col("r_expected")).alias("r_expected"), pick(z).alias("z_score"), pick(two_sided(z), 1.0).alias("p_value"))


def quadrat_density(points: DataFrame, n_bins: int = 10) -> DataFrame:
    """cluster, chi2 (against even counts, empty quadrats included), p_value, density_mean, density_std over n_bins^2 quadrats of the whole box."""
    box = points.agg((F.min("x") - 1e-6).alias("x0"), (F.max("x") + 1e-6).alias("x1"), (F.min("y") - 1e-6).alias("y0"), (F.max("y") + 1e-6).alias("y1"))
    cell = lambda c, lo, hi: F.least(F.lit(n_bins - 1), F.floor((F.col(c) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / n_bins)))
    counts = points.crossJoin(F.broadcast(box)).groupBy("cluster", cell("x", "x0", "x1").alias("i"), cell("y", "y0", "y1").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("c"))  # one row
    quads = float(n_bins * n_bins)
    sums = counts.groupBy("cluster").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    mean = F.col("n") / quads
    out = sums.select("cluster", (F.col("s") / mean - F.col("n")).alias("chi2"), mean.alias("density_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s") / quads - mean * mean)).alias("density_std"))

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # a row a cluster
            yield b.assign(p_value=[chi2_sf(v, n_bins * n_bins - 1) for v in b["chi2"]])

    kind = points.schema["cluster"].dataType.simpleString()
    return out.mapInPandas(tail, f"cluster {kind}, chi2 double, density_mean double, density_std double, p_value double")


#: Edges that are counted at once under all permutations.
EDGES = 1 << 20


def _dealt(h: np.ndarray, seed: int, rep: int) -> np.ndarray:
    """The cells' hashes of a permutation, from their own hashes (a finaliser of two rounds)."""
    key = np.uint64(((rep + 1) * 0x9E3779B97F4A7C15 + (seed << 32)) & 0xFFFFFFFFFFFFFFFF)
    z = h.view(np.uint64) ^ key
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permutation_test(edges: DataFrame, clusters: DataFrame, n_permutations: int = 1000, statistic: str = "ratio", seed: int = 42) -> DataFrame:
    """cluster_a, cluster_b, observed_ratio, p_value, z_score of edges between clusters under label permutation. statistic: "ratio" (observed over
    expected, of labelled edges) or "count".

    A permutation ranks the cells by a hash of its own and deals the labels out along the ranks, so a cell's label follows from its hash and the hashes at
    which one label's share ends and the next one's begins. Those are found from counts by hash prefix and a ranking of the few cells with the
    prefix in which a share ends; edges are then counted in place, each cell of a run of EDGES edges labelled once. Cells and edges stay where they are at every size."""
    if statistic not in ("ratio", "count"):
        raise ValueError("statistic must be ratio or count")
    named = checkpointed(clusters.where("cluster is not null").select(F.xxhash64(F.lit(seed), "cell_id").alias("h"), "cell_id", F.col("cluster").cast("string").alias("c")))
    sizes = sorted(map(tuple, named.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()))  # a row a cluster
    names, n = [c for c, _ in sizes], sum(m for _, m in sizes)
    ends, kinds = np.cumsum([m for _, m in sizes], dtype=np.int64)[:-1], len(names)
    end = lambda s: named.select(F.col("cell_id").alias(f"cell_id_{s}"), F.col("h").alias(f"h{s}"), F.col("c").alias(f"c{s}"))
    labelled = checkpointed(edges.select("cell_id_a", "cell_id_b").join(end("a"), "cell_id_a").join(end("b"), "cell_id_b").select("ha", "hb", "ca", "cb"))
    last = _ends(named, ends, n, n_permutations, seed)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((n_permutations, kinds * kinds), np.int64)

        def add(held: list[np.ndarray]) -> None:
            cells, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            a, b = at.reshape(2, -1)
            for rep in range(n_permutations):
                h = _dealt(cells, seed, rep)
                label = np.zeros(len(h), np.int64)
                for t in last[rep]:
                    label += h > t
                m[rep] += np.bincount((label * kinds)[a] + label[b], minlength=kinds * kinds)

        held, size = [], 0
        for b in batches:
            held.append(b[["ha", "hb"]].to_numpy().T)
            size += len(b)
            if size >= EDGES:
                add(held)
                held, size = [], 0
        if size:
            add(held)
        rep, pair = np.nonzero(m)
        yield pd.DataFrame({"rep": rep, "x": (pair // kinds).astype(np.int32), "y": (pair % kinds).astype(np.int32), "n": m[rep, pair]})

    null = labelled.select("ha", "hb").mapInPandas(counted, "rep long, x int, y int, n long")
    null = null.groupBy("rep", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("n").alias("n"))
    seen = labelled.groupBy(F.least("ca", "cb").alias("cluster_a"), F.greatest("ca", "cb").alias("cluster_b")).agg(F.count(F.lit(1)).alias("seen"))
    return _tested(sizes, null, seen, n_permutations, statistic)


#: Points whose neighbours are summed up at once, and permutations that are counted at once, where permuted labels are counted in tiles.
POINTS, REPS = 256, 64


def _slots(i: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows below n by how many of i they are, most first, and the at of the first of each, of the second of each that has one, and so on."""
    count = np.bincount(i, minlength=n)
    rows, first = np.argsort(-count, kind="stable"), np.cumsum(count) - count
    return rows, [at[first[rows[: np.count_nonzero(count > k)]] + k] for k in range(int(count.max(initial=0)))]


def permutation_test_near(points: DataFrame, radius: float, n_permutations: int = 1000, statistic: str = "ratio", seed: int = 42) -> DataFrame:
    """permutation_test() of the points (cell_id, x, y, cluster) at most radius apart, without a table of edges. In tiles, points lie in columns; those around a point
    and after it are a run of each column and a few more or less (Columns.onward), the same under every permutation, so their labels are differences of running sums, of many
    permutations at once and several labels in the digits of one number (exact: sums wrap around, but what is left fits the digits). Every tile has the same columns
    and order, so each pair is counted once."""
    if statistic not in ("ratio", "count"):
        raise ValueError("statistic must be ratio or count")
    named = points.where("cluster is not null").select(F.xxhash64(F.lit(seed), "cell_id").alias("h"), "cell_id", "x", "y", F.col("cluster").cast("string").alias("cluster"))
    sizes = sorted(map(tuple, named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()))  # a row a cluster
    names, n = [c for c, _ in sizes], sum(m for _, m in sizes)
    ends, kinds = np.cumsum([m for _, m in sizes], dtype=np.int64)[:-1], len(names)
    last = _ends(named, ends, n, n_permutations, seed)

    def counted(table: pa.Table) -> pa.Table:
        x, y, h, c = (table.column(k).to_numpy() for k in ("x", "y", "h", "c"))
        home = table.column("home").to_numpy(zero_copy_only=False)
        m = np.zeros((n_permutations + 1, kinds, kinds), np.int64)
        if home.any():
            keep = x >= x[home].min() - radius  # (what lies in a column before is met from there)
            near = nr.Columns(x[keep], y[keep], radius, wide, 0.0, (h[keep], x[keep]))
            h, c, own = h[keep][near.order], c[keep][near.order], np.flatnonzero(home[keep][near.order])
            lo, hi, more, less = near.onward(own)
            degree = (hi - lo).sum(axis=1) + np.bincount(more[0], minlength=len(own)) - np.bincount(less[0], minlength=len(own))
            bits = max(1, int(degree.max()).bit_length())
            each, mask = max(1, min(kinds - 1, 64 // bits)), np.uint64((1 << bits) - 1)
            parts = []
            for at in range(0, len(own), POINTS):
                some = [(i[slice(*np.searchsorted(i, [at, at + POINTS]))] - at, p[slice(*np.searchsorted(i, [at, at + POINTS]))]) for i, p in (more, less)]
                one, two = np.ascontiguousarray(lo[at : at + POINTS].T), np.ascontiguousarray(hi[at : at + POINTS].T)
                used = (one != two).any(axis=1)
                parts.append((own[at : at + POINTS], degree[at : at + POINTS].astype(float), one[used], two[used], *[_slots(*z, len(one[0])) for z in some]))
            for at in range(0, n_permutations + 1, REPS):
                reps = min(REPS, n_permutations + 1 - at)
                label = np.zeros((reps, len(h)), np.min_scalar_type(kinds))
                for rep in range(at, at + reps):
                    if rep == n_permutations:
                        label[rep - at] = c  # as seen
                        continue
                    dealt = _dealt(h, seed, rep)
                    for t in last[rep]:
                        label[rep - at] += dealt > t
                label = np.ascontiguousarray(label.T)
                for first in range(0, max(1, kinds - 1), each):
                    digit = np.zeros(kinds + 1, np.uint64)
                    some = range(first, min(first + each, kinds - 1))
                    digit[list(some)] = [1 << bits * (k - first) for k in some]
                    values = digit[label]
                    upto = np.zeros((len(h) + 1, reps), np.uint64)
                    for begin in range(0, len(h), POINTS):
                        np.cumsum(values[begin : begin + POINTS], axis=0, out=upto[begin + 1 : begin + POINTS + 1][: len(values) - begin])
                        upto[begin + 1 : begin + POINTS + 1] += upto[begin]
                    for points_, n_, one, two, plus, minus in parts:
                        sums, held = np.zeros((len(points_), reps), np.uint64), np.empty((len(points_), reps), np.uint64)
                        for i, j in zip(one, two, strict=True):
                            sums += np.take(upto, j, axis=0, out=held, mode="clip")
                            sums -= np.take(upto, i, axis=0, out=held, mode="clip")
                        for (rows_, slots), f in ((plus, np.add), (minus, np.subtract)):
                            if slots:
                                apart = np.zeros((len(slots[0]), reps), np.uint64)
                                for p in slots:
                                    apart[: len(p)] += np.take(values, p, axis=0, out=held[: len(p)], mode="clip")
                                sums[rows_[: len(apart)]] = f(sums[rows_[: len(apart)]], apart)
                        key = (label[points_] + np.arange(reps) * (kinds + 1)).ravel()
                        add = lambda v, key=key, reps=reps: np.bincount(key, v.ravel(), reps * (kinds + 1)).reshape(reps, kinds + 1)[:, :kinds].astype(np.int64)
                        if not first:
                            m[at : at + reps, :, kinds - 1] += add(np.broadcast_to(n_[:, None], sums.shape))
                        for k in some:
                            found = add((sums >> np.uint64(bits * (k - first)) & mask).astype(np.int64))
                            m[at : at + reps, :, k] += found
                            m[at : at + reps, :, kinds - 1] -= found
        m += m.transpose(0, 2, 1) * ~np.eye(kinds, dtype=bool)
        rep, a, b = np.nonzero(np.triu(m))
        return pa.table({"rep": rep, "x": a.astype(np.int32), "y": b.astype(np.int32), "n": m[rep, a, b]})

    rows = nr._placed(named).select("x", "y", "h", nr._code(names).alias("c"))
    # columns as wide as suits the points' mean density: a run costs two sums
    area = 12.0
    for v in rows.agg(F.stddev_pop("x"), F.stddev_pop("y")).first():
        area *= max(v or 0.0, radius / 4)
    wide = int(np.clip(1 + 0.6 * math.sqrt(n * radius * radius / area), 1, 32))
    once = nr._dealt(rows, radius, max(nr.TILE, min(8 * nr.TILE, n // nr.TILES))).groupBy("t").applyInArrow(counted, "rep long, x int, y int, n long")
    both = checkpointed(once.groupBy("rep", "x", "y").agg(F.sum("n").alias("n")))  # rows: permutations by pairs of clusters
    place = points.sparkSession.createDataFrame(list(enumerate(names)), "i int, c string")
    seen = both.where(F.col("rep") == n_permutations)
    for c, k in (("x", "cluster_a"), ("y", "cluster_b")):
        seen = seen.join(F.broadcast(place.select(F.col("i").alias(c), F.col("c").alias(k))), c)  # a row a cluster
    return _tested(sizes, both.where(F.col("rep") < n_permutations), seen.select("cluster_a", "cluster_b", F.col("n").alias("seen")), n_permutations, statistic)


def _ends(named: DataFrame, ends: np.ndarray, n: int, n_permutations: int, seed: int) -> np.ndarray:
    """For each permutation, the hash of the last cell of each label's share but the last one's, of n cells (h: their own hashes)."""
    bits = int(np.clip(np.log2(max(1, n / 64)), 4, 12))
    shift = np.uint64(64 - bits)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((n_permutations, 1 << bits), np.int64)
        for b in batches:
            for rep in range(n_permutations):
                m[rep] += np.bincount((_dealt(b["h"].to_numpy(), seed, rep) >> shift).astype(np.int64), minlength=1 << bits)
        if m.any():
            yield pd.DataFrame({"rep": np.arange(n_permutations), "m": list(m)})

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        upto = np.cumsum(np.sum(rows["m"].to_list(), axis=0))
        p = np.searchsorted(upto, ends)  # the prefix in which each share ends
        return pd.DataFrame({"rep": rows["rep"].iloc[0], "i": np.arange(len(ends)), "p": p, "k": ends - np.concatenate([[0], upto])[p]})

    cuts = named.select("h").mapInPandas(prefixes, "rep long, m array<long>").groupBy("rep").applyInPandas(cut, "rep long, i long, p long, k long").toPandas()  # a row a permutation and cluster
    of = np.zeros((n_permutations, len(ends)), np.int64)
    rank = of.copy()
    of[cuts["rep"], cuts["i"]], rank[cuts["rep"], cuts["i"]] = cuts["p"], cuts["k"]

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep in range(n_permutations):
                h = _dealt(b["h"].to_numpy(), seed, rep)
                ending = np.zeros(1 << bits, bool)
                ending[of[rep]] = True
                h = h[ending[(h >> shift).astype(np.int64)]]
                yield pd.DataFrame({"rep": np.full(len(h), rep), "h": h.view(np.int64)})

    def ranked(rows: pd.DataFrame) -> pd.DataFrame:
        rep, h = int(rows["rep"].iloc[0]), np.sort(rows["h"].to_numpy().view(np.uint64))
        first = np.searchsorted((h >> shift).astype(np.int64), of[rep])
        return pd.DataFrame({"rep": rep, "i": np.arange(len(ends)), "h": h[first + rank[rep] - 1].view(np.int64)})

    last = np.zeros((n_permutations, len(ends)), np.uint64)
    if len(ends):
        found = named.select("h").mapInPandas(few, "rep long, h long").groupBy("rep").applyInPandas(ranked, "rep long, i long, h long").toPandas()  # as many rows
        last[found["rep"], found["i"]] = found["h"].to_numpy().view(np.uint64)

    return last


def _tested(sizes: list[tuple], null: DataFrame, seen: DataFrame, n_permutations: int, statistic: str) -> DataFrame:
    """The test's table. sizes: (cluster, cells) by cluster; null: rep, x <= y (places in sizes), n edges; seen: cluster_a, cluster_b, seen."""
    spark, names = null.sparkSession, [c for c, _ in sizes]
    place = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "i int, c string")
    first, second = place.select(F.col("i").alias("x"), F.col("c").alias("cluster_a")), place.select(F.col("i").alias("y"), F.col("c").alias("cluster_b"))
    base = first.join(second, F.col("x") <= F.col("y")).join(seen, ["cluster_a", "cluster_b"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))  # clusters squared
    # a pair without an edge in a permutation has no row there: its zeros are added to the sums
    sums = base.join(null, ["x", "y"], "left").groupBy("cluster_a", "cluster_b", "seen").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("q"), F.count_if(F.col("n") >= F.col("seen")).alias("above"), F.count("n").alias("some"))
    mean = F.col("s") / n_permutations
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n_permutations - mean * mean))
    above = F.col("above") + F.when(F.col("seen") == 0, n_permutations - F.col("some")).otherwise(0)
    out = sums.select("cluster_a", "cluster_b", "seen", ((above + 1) / (n_permutations + 1)).alias("p_value"), F.when(sd > 0, (F.col("seen") - mean) / sd).otherwise(0.0).alias("z_score"))
    if statistic == "count":
        return out.select("cluster_a", "cluster_b", F.col("seen").cast("double").alias("observed_ratio"), "p_value", "z_score")
    sums_of = spark.createDataFrame(sizes, "c string, n long")
    ratio = ratios(sums_of, seen.withColumnRenamed("seen", "n"), seen.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("edges_all"))).select("cluster_a", "cluster_b", F.col("ratio").alias("observed_ratio"))
    return out.join(ratio, ["cluster_a", "cluster_b"]).select("cluster_a", "cluster_b", "observed_ratio", "p_value", "z_score")


def _pattern(function: str, pts: np.ndarray, r: np.ndarray, rng) -> np.ndarray:
    """The function of a pattern held by one task."""
    n = len(pts)
    area = max(np.ptp(pts[:, 0]) * np.ptp(pts[:, 1]), TINY)

    def least(queries, skip):
        """Each query's distance to the nearest point, infinite beyond the last radius: looked for ever further out."""
        out, reach = np.full(len(queries), np.inf), min(r[-1], 2 * np.sqrt(area / n))
        left = np.arange(len(queries))
        while True:
            for i, j, d in within(*queries[left].T, *pts.T, reach):
                if skip:
                    other = j != left[i]
                    i, d = i[other], d[other]
                np.minimum.at(out, left[i], d)
            left = left[out[left] == np.inf]
            if reach >= r[-1] or not len(left):
                return out
            reach = min(r[-1], 2 * reach)

    if function in ("K", "L"):
        m = np.zeros(len(r))
        for _, _, d in within(*pts.T, *pts.T, r[-1]):
            m += np.cumsum(np.bincount(np.searchsorted(r, d), minlength=len(r) + 1)[: len(r)])
        value = area / (n * (n - 1)) * (m - n)
        return value if function == "K" else np.sqrt(np.maximum(value, 0) / np.pi) - r
    if function == "G":
        d = least(pts, True)
    else:
        m = min(1000, n)
        d = least(np.column_stack([rng.uniform(pts[:, k].min(), pts[:, k].max(), m) for k in (0, 1)]), False)
    return (d[:, None] <= r).mean(axis=0)


def dclf_envelope(points: DataFrame, function: str = "K", n_simulations: int = 199, n_radii: int = 50, max_radius: float | None = None, max_cells: int = 100_000, seed: int = 42, tasks: int = 8) -> DataFrame:
    """cluster, r, observed, lo, hi, theo, p_value: the function against n_simulations random patterns of as many points, and the rank of its largest
    deviation. Above max_cells points, a seeded sample of so many stands for the cluster (as the feature has it)."""
    if function not in ("K", "L", "G", "F"):
        raise ValueError(f"function must be K, L, G or F, not {function}")
    spark = points.sparkSession
    boxes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("n > 1").collect()
    out = None
    for b in boxes:  # a row a cluster
        own = points.where(F.col("cluster").eqNullSafe(F.lit(b.cluster))).orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id").limit(max_cells)
        pts = own.select("x", "y").toPandas().to_numpy()
        n = len(pts)
        (x0, y0), (x1, y1) = pts.min(axis=0), pts.max(axis=0)
        top = max_radius or min(x1 - x0, y1 - y0) / 4
        r = np.arange(1, n_radii + 1) * top / n_radii
        theo = {"K": np.pi * r**2, "L": 0 * r}.get(function, 1 - np.exp(-n / max((x1 - x0) * (y1 - y0), TINY) * np.pi * r**2))
        seen = _pattern(function, pts, r, np.random.default_rng([seed, n_simulations]))

        def work(batches: Iterator[pd.DataFrame], n=n, r=r, theo=theo, span=(x0, x1, y0, y1)) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for rep in batch["id"]:
                    rng = np.random.default_rng([seed, int(rep)])
                    sim = _pattern(function, np.column_stack([rng.uniform(*span[:2], n), rng.uniform(*span[2:], n)]), r, rng)
                    yield pd.DataFrame({"j": np.arange(len(r)), "v": sim, "far": np.abs(sim - theo).max()})

        sims = spark.range(0, n_simulations, 1, tasks).mapInPandas(work, "j int, v double, far double")
        base = spark.createDataFrame(pd.DataFrame({"j": np.arange(n_radii, dtype=np.int32), "r": r, "observed": seen, "theo": theo}))
        far = float(np.abs(seen - theo).max())
        env = sims.groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), ((F.count_if(F.col("far") >= far) + 1) / (n_simulations + 1)).alias("p_value"))
        one = base.join(env, "j").select(F.lit(b.cluster).alias("cluster"), "r", "observed", "lo", "hi", "theo", "p_value")
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], "cluster string, r double, observed double, lo double, hi double, theo double, p_value double")
    return out
