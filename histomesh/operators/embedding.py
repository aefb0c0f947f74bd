"""Operators on embeddings (cell_id, v: array<double>): neighbours, smoothing, reduction, clustering, imputation, batch correction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.operators.cells import ranked
from histomesh.sources.catalog import checkpointed

#: Rows of an embedding that hierarchical() and the layouts take on the driver.
DRIVER_ROWS = 20_000
#: Rows up to which a diffusion map is taken from the whole matrix; entries of a block of distances or products on the driver.
DENSE, ENTRIES = 1500, 1 << 22
#: Rows of a block in neighbour search, about; pivots at most; rows whose distances are held at once.
BLOCK, MAX_PIVOTS, CHUNK = 2048, 16_384, 256
#: Blocks that are searched as one, and the bytes of rows that they may have together: each is written once for every such group of rows that asks it.
TOGETHER, HELD = 8, 1 << 24


def matrix(emb: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and rows by id; for kernels on the driver, which are refused above DRIVER_ROWS."""
    rows = emb.orderBy("cell_id").limit(DRIVER_ROWS + 1).collect()
    if len(rows) > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} rows; use the distributed operator")
    return [r.cell_id for r in rows], np.array([r.v for r in rows], float)


def _held(emb: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows by id, in arrays on the driver."""
    table = emb.where("v is not null").select("cell_id", F.col("v").cast("array<double>").alias("v")).orderBy("cell_id").toArrow()
    rows = table.column("v").combine_chunks()
    return table.column("cell_id").to_numpy(), rows.flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _columns(emb: DataFrame, ids, **columns) -> DataFrame:
    """cell_id and columns held on the driver."""
    table = pa.table({"cell_id": pa.array(ids), **columns})
    kinds = emb.sparkSession.createDataFrame(table) if len(table) else None
    if kinds is None:
        kind = emb.schema["cell_id"].dataType.simpleString()
        return emb.sparkSession.createDataFrame([], f"cell_id {kind}, " + ", ".join(f"{c} {'int' if c == 'label' else 'array<double>'}" for c in columns))
    return kinds.withColumn("cell_id", F.col("cell_id").cast(emb.schema["cell_id"].dataType))


def _places(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value among sorted ids."""
    return np.searchsorted(ids, values)


def _nearest_rows(x: np.ndarray, y: np.ndarray, k: int, skip: np.ndarray | None, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, d) of the k nearest rows of y within bound, nearest first, ties in order of y. skip: for each row of x the row of y left out, or -1.
    A matrix product picks candidates with room for rounding; their distances are then taken exactly."""
    out = [], [], []
    yy = (y * y).sum(axis=1)
    for at in range(0, len(x), CHUNK):
        q = x[at : at + CHUNK]
        xx = (q * q).sum(axis=1)[:, None]
        d2 = np.maximum(xx + yy - 2 * q @ y.T, 0)
        if skip is not None:
            row = np.flatnonzero(skip[at : at + CHUNK] >= 0)
            d2[row, skip[at : at + CHUNK][row]] = np.inf
        room = 1e-9 * (xx + yy.max(initial=0.0)) + 1e-300
        top = np.partition(d2, k - 1, axis=1)[:, k - 1 : k] if d2.shape[1] > k else np.full((len(q), 1), np.inf)
        row, col = np.nonzero((d2 <= np.minimum(top, bound[at : at + CHUNK, None] ** 2) + room) & np.isfinite(d2))
        d = np.sqrt(((q[row] - y[col]) ** 2).sum(axis=1))
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        for have, more in zip(out, (row[keep] + at, col[keep], d[keep]), strict=True):
            have.append(more)
    return tuple(np.concatenate([np.zeros(0, float if i == 2 else np.int64), *v]) for i, v in enumerate(out))


def nearest(emb: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """cell_id, other, d: the k nearest rows of targets (of emb itself, but the row) by Euclidean distance, exactly; ties by id.

    Targets lie in cells around pivots (some of them, picked by hash), in blocks of about BLOCK rows. A row first looks at one block of the cell of its
    nearest pivot, which bounds its k-th distance, and then at the blocks of every cell that the bound can reach: by the triangle inequality
    those whose pivot is no further than the bound and the cell's radius. Up to TOGETHER blocks of neighbouring pivots are searched as one. Where nothing can be
    ruled out, each pair of such is one group, as large as any other."""
    own = targets is None
    kind = emb.schema["cell_id"].dataType.simpleString()
    rows = lambda df: df.where("cell_id is not null and v is not null").select("cell_id", F.col("v").cast("array<double>").alias("v"))
    held = checkpointed(rows(emb if own else targets))
    m = held.count()
    if not m:
        return emb.select("cell_id", F.col("cell_id").alias("other"), F.lit(0.0).alias("d")).limit(0)
    size = max(BLOCK, 2 * k)
    n_pivots = min(MAX_PIVOTS, max(1, -(-m // size)))
    pivots = np.array([r.v for r in held.orderBy(F.xxhash64(F.lit(7), "cell_id")).limit(n_pivots).collect()], float)  # at most MAX_PIVOTS rows
    # in an order that follows their widest direction
    pivots = pivots[np.argsort((pivots - pivots.mean(axis=0)) @ np.linalg.eigh(np.cov(pivots.T).reshape(pivots.shape[1], -1))[1][:, -1], kind="stable")] if n_pivots > 2 else pivots
    joint = max(1, min(TOGETHER, HELD // (8 * size * max(1, pivots.shape[1]))))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c, _, far = (x for x in _to_pivots(np.array(b["v"].tolist(), float), pivots))
                yield b.assign(c=c, far=far)

    held = checkpointed(held.mapInPandas(assigned, f"cell_id {kind}, v array<double>, c int, far double"))
    cells = {r.c: (r.n, r.far) for r in held.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # a row a pivot
    blocks, radius = np.ones(n_pivots, np.int64), np.full(n_pivots, -np.inf)
    for c, (n, far) in cells.items():
        blocks[c], radius[c] = -(-n // size), far
    first = np.cumsum(blocks) - blocks
    groups = int(blocks.sum()) // joint + 1
    spot = emb.sparkSession.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(first, blocks, strict=True))], "c int, first long, blocks long")
    block = F.floor((F.col("first") + F.pmod(F.xxhash64("cell_id"), "blocks")) / joint)
    held = held.join(F.broadcast(spot), "c").select("cell_id", "v", "c", block.alias("t"))  # a row a pivot
    held = checkpointed(held)
    if own:
        asked = held
    else:
        asked = rows(emb).mapInPandas(assigned, f"cell_id {kind}, v array<double>, c int, far double").join(F.broadcast(spot), "c")
        asked = checkpointed(asked.select("cell_id", "v", "c", block.alias("t")))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("cell_id", kind="stable")
        if not len(a) or not len(b):
            return pd.DataFrame({"cell_id": a["cell_id"][:0], "other": b["cell_id"][:0], "d": np.zeros(0)})
        skip = None
        if own:
            at = pd.Series(np.arange(len(b)), index=b["cell_id"].to_numpy())
            skip = at.reindex(a["cell_id"].to_numpy()).fillna(-1).to_numpy().astype(np.int64)
        bound = a["r"].to_numpy(float) if "r" in a else np.full(len(a), np.inf)
        row, col, d = _nearest_rows(np.array(a["v"].tolist(), float), np.array(b["v"].tolist(), float), k, skip, bound)
        return pd.DataFrame({"cell_id": a["cell_id"].to_numpy()[row], "other": b["cell_id"].to_numpy()[col], "d": d})

    def dealt(q: DataFrame, to: str) -> DataFrame:
        """Pairs of a block of rows and a block of targets: rows that ask one block are split into runs of about as many as a block has."""
        runs = q.groupBy(to).agg(F.ceil(F.count(F.lit(1)) / (size * joint)).cast("int").alias("runs"))
        left = q.join(runs, to).withColumn("run", F.pmod(F.xxhash64(F.lit(3), "cell_id"), "runs"))
        if "v" not in q.columns:
            left = left.join(asked.select("cell_id", "v"), "cell_id")
        fresh = lambda df, *names: df.select(*[F.col(c).alias(n) for c, n in names])  # noqa: E731 (columns of their own, though the table be the same)
        right = fresh(held, ("cell_id", "cell_id"), ("v", "v"), ("t", to)).join(fresh(runs, (to, to), ("runs", "runs")), to).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs").cast("long") - 1)))
        return left.groupBy(to, "run").cogroup(right.groupBy(to, "run")).applyInPandas(search, f"cell_id {kind}, other {kind}, d double")

    near = checkpointed(dealt(asked, "t"))
    bound = asked.join(near.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")), "cell_id", "left")
    bound = bound.select("cell_id", "v", "t", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("r"))

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.iloc[at : at + CHUNK]
                _, far, _ = _to_pivots(np.array(part["v"].tolist(), float), pivots)
                row, c = np.nonzero(far <= part["r"].to_numpy(float)[:, None] * (1 + 1e-9) + radius * (1 + 1e-9) + 1e-9 * far)
                n = blocks[c]
                to = (np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())) // joint
                row, to = np.divmod(np.unique(np.repeat(row, n) * groups + to), groups)
                part = part.iloc[row].assign(to=to)
                yield part[part["to"] != part["t"]][["cell_id", "r", "to"]]

    # kept without the rows themselves, which would be written once for each block
    more = dealt(checkpointed(bound.mapInPandas(reached, f"cell_id {kind}, r double, to long")), "to")
    return ranked(near.union(more), ["cell_id"], ["d", "other"], k).select("cell_id", "other", "d")


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest pivot, distances to all, distance to the nearest) of each row."""
    far = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))
    c = far.argmin(axis=1)
    return c.astype(np.int32), far, np.sqrt(((x - pivots[c]) ** 2).sum(axis=1))


def knn_edges(emb: DataFrame, k: int = 15) -> DataFrame:
    """cell_id_a < cell_id_b: undirected neighbour pairs, once."""
    return nearest(emb, k).select(F.least("cell_id", "other").alias("cell_id_a"), F.greatest("cell_id", "other").alias("cell_id_b")).distinct()


def knn_smooth(emb: DataFrame, k: int = 15) -> DataFrame:
    """Each row as the mean of its k nearest others."""
    near = nearest(emb, k).join(emb.select(F.col("cell_id").alias("other"), "v"), "other").select("cell_id", F.posexplode("v").alias("i", "x"))
    means = near.groupBy("cell_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


def transfer_labels(emb: DataFrame, labelled: DataFrame) -> DataFrame:
    """cell_id, label of the nearest row of labelled (cell_id, v, label)."""
    near = nearest(emb.select("cell_id", "v"), 1, labelled.select("cell_id", "v"))
    return near.join(labelled.select(F.col("cell_id").alias("other"), "label"), "other").select("cell_id", "label")


def pca(emb: DataFrame, n_components: int = 50, n_subsample: int = 100_000) -> tuple[DataFrame, np.ndarray]:
    """(scores as cell_id, v; loadings, features x components). Fitted on at most n_subsample rows by seeded hash, all rows centred and projected; the
    largest loading of a component is positive."""
    dim = len(emb.first().v)
    k = max(1, min(n_components, dim, emb.count() - 1))
    fit = emb.orderBy(F.xxhash64(F.lit(42), "cell_id")).limit(n_subsample).select(array_to_vector("v").alias("f"))
    load = PCA(k=k, inputCol="f", outputCol="p").fit(fit).pc.toArray()
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    mean = emb.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").toPandas()["m"].to_numpy()  # a row a feature
    return project(emb, mean, load), load


def project(emb: DataFrame, mean: np.ndarray, load: np.ndarray) -> DataFrame:
    kind = emb.schema["cell_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell_id": b["cell_id"], "v": list((np.array(b["v"].tolist(), float).reshape(len(b), -1) - mean) @ load)}) if len(b) else b[["cell_id", "v"]]

    return emb.select("cell_id", "v").mapInPandas(run, f"cell_id {kind}, v array<double>")


def kmeans(emb: DataFrame, n_clusters: int = 10, seed: int = 42, n_init: int = 10) -> DataFrame:
    """cell_id, label: the cheapest of n_init runs of k-means."""
    rows = emb.select("cell_id", array_to_vector("v").alias("features"))
    fits = [KMeans(k=n_clusters, seed=seed + i).fit(rows) for i in range(n_init)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("cell_id", F.col("prediction").alias("label"))


def hierarchical(emb: DataFrame, n_clusters: int = 10) -> DataFrame:
    """cell_id, label: Ward agglomeration on the driver. Above DRIVER_ROWS it raises; ward_clusters() takes any number."""
    ids, x = matrix(emb)
    return _labels(emb, ids, ward(x, n_clusters))


def ward_clusters(emb: DataFrame, n_clusters: int = 10) -> DataFrame:
    """cell_id, label: Ward agglomeration of all rows, which are held on the driver as one array. All clusters that are each other's nearest merge at once."""
    ids, x = _held(emb)
    return _columns(emb, ids, label=pa.array(ward(x, n_clusters), pa.int32()))


def _labels(emb: DataFrame, ids: list, labels) -> DataFrame:
    kind = emb.schema["cell_id"].dataType.simpleString()
    return emb.sparkSession.createDataFrame(list(zip(ids, map(int, labels), strict=True)), f"cell_id {kind}, label int")


def ward(x: np.ndarray, n_clusters: int) -> np.ndarray:
    """Labels by rounds of merging all pairs that are each other's nearest. That gives the tree of merging the closest pair each time, as a merged cluster
    is no nearer to a third one than the nearer of its parts; for the same reason only those look again whose nearest has merged."""
    n = len(x)
    centre, size = x - (x.mean(axis=0) if n else 0.0), np.ones(n)
    member, name = np.arange(n), np.arange(n)
    near, cost = np.zeros(n, np.int64), np.full(n, np.inf)
    merges, look = [], np.arange(n)
    while len(centre) > 1:
        square, step = (centre * centre).sum(axis=1)[:, None], max(1, ENTRIES // len(centre))
        # squared distances as one product; a pair's cost divides them by the sum of the inverse sizes
        right, inverse = np.hstack([-2 * centre, np.ones_like(square), square]).T, 1 / size
        for at in range(0, len(look), step):
            i = look[at : at + step]
            d = np.hstack([centre[i], square[i], np.ones((len(i), 1))]) @ right
            if len(centre) < n:
                d /= inverse[i, None] + inverse
            d[np.arange(len(i)), i] = np.inf
            near[i] = d.argmin(axis=1)
        cost[look] = ((centre[look] - centre[near[look]]) ** 2).sum(axis=1) * size[look] * size[near[look]] / (size[look] + size[near[look]])
        a = np.flatnonzero((near[near] == np.arange(len(near))) & (np.arange(len(near)) < near))
        if not len(a):  # rounding among equal distances
            a = cost.argmin()[None]
        b = near[a]
        merges += zip(cost[a].tolist(), name[a].tolist(), name[b].tolist(), strict=True)
        whole = size[a] + size[b]
        centre[b] = (centre[a] * size[a, None] + centre[b] * size[b, None]) / whole[:, None]
        size[b] = whole
        gone, merged = np.zeros(len(near), bool), np.zeros(len(near), bool)
        gone[a], merged[a], merged[b] = True, True, True
        again = (merged | merged[near])[~gone]
        place = np.cumsum(~gone) - 1
        near, cost, centre, size, name = place[near[~gone]], cost[~gone], centre[~gone], size[~gone], name[~gone]
        look = np.flatnonzero(again)

    def find(k):
        while member[k] != k:
            member[k] = member[member[k]]
            k = member[k]
        return k

    for _, a, b in sorted(merges)[: max(0, n - n_clusters)]:
        member[find(a)] = find(b)
    roots = [find(k) for k in range(n)]
    names: dict[int, int] = {}
    return np.array([names.setdefault(r, len(names)) for r in roots])


def modularity_clusters(emb: DataFrame, k: int = 15, resolution: float = 1.0, refine: bool = True, seed: int = 42) -> DataFrame:
    """cell_id, label: communities of the neighbour graph by local moves and aggregation (Louvain); refine splits communities that fell apart into
    their connected parts between levels (as Leiden guarantees). Edges are found by Spark; all of them are held on the driver, where the moves run."""
    ids = emb.where("v is not null").select("cell_id").orderBy("cell_id").toArrow().column("cell_id").to_numpy()
    edges = knn_edges(emb, k).toArrow()
    a, b = (_places(ids, edges.column(c).to_numpy()) for c in ("cell_id_a", "cell_id_b"))
    del edges
    order = np.lexsort((np.concatenate([b, a]), np.concatenate([a, b])))
    other, upto = np.concatenate([b, a])[order], np.searchsorted(np.concatenate([a, b])[order], np.arange(len(ids) + 1))
    names = list(range(len(ids)))  # one object a node
    graph = [dict.fromkeys([names[u] for u in other[s:e].tolist()], 1.0) for s, e in zip(upto[:-1], upto[1:], strict=True)]
    return _columns(emb, ids, label=pa.array(communities(graph, resolution, refine, seed), pa.int32()))


def communities(graph: list[dict[int, float]], resolution: float = 1.0, refine: bool = True, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    label = np.arange(len(graph))
    loops = np.zeros(len(graph))
    while True:
        degree = np.array([sum(g.values()) for g in graph]) + loops
        total = degree.sum() or 1.0
        of, weight = np.arange(len(graph)), degree.copy()
        moved = True
        while moved:
            moved = False
            for v in rng.permutation(len(graph)):
                near: dict[int, float] = {int(of[v]): 0.0}
                for u, w in graph[v].items():
                    near[int(of[u])] = near.get(int(of[u]), 0.0) + w
                weight[of[v]] -= degree[v]
                best = max(near, key=lambda c: (near[c] - resolution * degree[v] * weight[c] / total, c == of[v], -c))
                moved |= best != of[v]
                of[v] = best
                weight[best] += degree[v]
        if refine:
            of = _connected_parts(graph, of)
        names: dict[int, int] = {}
        of = np.array([names.setdefault(int(c), len(names)) for c in of])
        label = of[label]
        if len(names) == len(graph):
            return label
        merged: list[dict[int, float]] = [{} for _ in names]
        inner = np.zeros(len(names))
        np.add.at(inner, of, loops)
        for v, g in enumerate(graph):
            for u, w in g.items():
                if of[u] == of[v]:
                    inner[of[v]] += w
                else:
                    merged[of[v]][int(of[u])] = merged[of[v]].get(int(of[u]), 0.0) + w
        graph, loops = merged, inner


def _connected_parts(graph: list[dict[int, float]], of: np.ndarray) -> np.ndarray:
    part = np.full(len(graph), -1)
    for start in range(len(graph)):
        if part[start] < 0:
            part[start], todo = start, [start]
            while todo:
                v = todo.pop()
                for u in graph[v]:
                    if part[u] < 0 and of[u] == of[v]:
                        part[u] = start
                        todo.append(u)
    return part


def diffmap(emb: DataFrame, n_components: int = 15) -> DataFrame:
    """cell_id, v: leading eigenvectors (but the trivial one) of the row-normalised kernel over up to 30 neighbours, widths by the distance to the last.
    The kernel's entries, some 60 a row, are held on the driver."""
    ids = emb.where("v is not null").select("cell_id").orderBy("cell_id").toArrow().column("cell_id").to_numpy()
    n = len(ids)
    k = min(30, n - 1)
    near = nearest(emb, k).toArrow()
    a, b, d = _places(ids, near.column("cell_id").to_numpy()), _places(ids, near.column("other").to_numpy()), near.column("d").to_numpy()
    del near
    width = np.zeros(n)
    np.maximum.at(width, a, d)
    width[width == 0] = 1e-10
    w = np.exp(-d * d / (width[a] * width[b]))
    pair = np.concatenate([a * n + b, b * n + a])
    pair, at = np.unique(pair, return_inverse=True)  # the greater of both ways: they are equal where there are both
    both = np.zeros(len(pair))
    both[at] = np.concatenate([w, w])
    row, col = pair // n, pair % n
    root = np.sqrt(np.maximum(np.bincount(row, both, n), 1e-300))
    m = min(n_components, n - 2)
    vector = leading(row, col, both / (root[row] * root[col]), n, m + 1)
    top = (vector / root[:, None])[:, 1 : m + 1]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(m)])
    return _columns(emb, ids, v=pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * m, top.ravel()))


def leading(row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, m: int, steps: int = 5, most: int = 300, seed: int = 0) -> np.ndarray:
    """The m eigenvectors of the largest eigenvalues of a symmetric matrix, given by its entries in order of rows: from the whole matrix up to DENSE rows, else
    by block Krylov spaces that begin anew from their best vectors until all residuals are below 1e-9. A block holds more vectors than are asked for, so that
    equal eigenvalues (of a graph in several parts) are all found."""
    if n <= DENSE:
        whole = np.zeros((n, n))
        whole[row, col] = w
        return np.linalg.eigh(whole)[1][:, ::-1][:, :m]
    starts = np.searchsorted(row, np.arange(n + 1))
    block = m + 8
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + ENTRIES // block, "right")) - 1))

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            i, j = starts[s], starts[e]
            if i < j:
                full = np.flatnonzero(starts[s:e] < starts[s + 1 : e + 1])
                out[s + full] = np.add.reduceat(x[col[i:j]] * w[i:j, None], starts[s + full] - i, axis=0)
        return out

    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, block)))[0]
    for _ in range(most):
        space, product = [x], [times(x)]
        for _ in range(steps - 1):
            y = product[-1].copy()
            for _ in range(2):
                for q in space:
                    y -= q @ (q.T @ y)
            # (directions that are spent come out of qr at random, orthogonal but for what they share with the space)
            y = np.linalg.qr(y)[0]
            for q in space:
                y -= q @ (q.T @ y)
            space.append(np.linalg.qr(y)[0])
            product.append(times(space[-1]))
        q, aq = np.hstack(space), np.hstack(product)
        t = q.T @ aq
        value, turn = np.linalg.eigh((t + t.T) / 2)
        turn = turn[:, ::-1][:, :block]
        x, ax = q @ turn, aq @ turn
        if np.sqrt(((ax - x * value[::-1][:block]) ** 2).sum(axis=0))[:m].max() < 1e-9:
            return x[:, :m]
        x = np.linalg.qr(x)[0]
    raise ArithmeticError("eigenvectors didn't settle")


def magic(emb: DataFrame, k: int = 5, t: int = 3) -> DataFrame:
    """Markov smoothing: an adaptive Gaussian kernel over k neighbours and the row itself, applied t times as joins along edges."""
    near = nearest(emb, k)
    width = near.groupBy("cell_id").agg(F.max("d").alias("s"))
    w = near.join(width, "cell_id").select("cell_id", "other", F.exp(-F.pow(F.col("d") / F.greatest("s", F.lit(1e-10)), 2)).alias("w"))
    w = w.union(w.select("other", "cell_id", "w")).union(emb.select("cell_id", F.col("cell_id").alias("other"), F.lit(2.0).alias("w"))).groupBy("cell_id", "other").agg((F.sum("w") / 2).alias("w"))
    whole = w.groupBy("cell_id").agg(F.sum("w").alias("whole"))
    step = checkpointed(w.join(whole, "cell_id").select("cell_id", "other", (F.col("w") / F.col("whole")).alias("w")))
    now = emb.select("cell_id", F.posexplode("v").alias("i", "x"))
    for _ in range(t):
        now = checkpointed(step.join(now.withColumnRenamed("cell_id", "other"), "other").groupBy("cell_id", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x")))
    return now.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


def alra(emb: DataFrame, rank: int = 10, quantile: float = 0.001) -> DataFrame:
    """Low-rank imputation: the rank-k approximation (from the Gram matrix, features squared), values below the size of the feature's most
    negative quantile set to 0, the rest rescaled to the observed mean and spread of positive values; observed values that fell to 0 stay."""
    dim = len(emb.first().v)
    gram = np.zeros((dim, dim))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((dim, dim))
        for b in batches:
            x = np.array(b["v"].tolist(), float).reshape(-1, dim)
            g += x.T @ x
        yield pd.DataFrame({"g": [g.ravel()]})

    sums = emb.select("v").mapInPandas(part, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # features squared
    gram.ravel()[sums["i"].to_numpy()] = sums["x"].to_numpy()
    _, vec = np.linalg.eigh(gram)
    top = vec[:, ::-1][:, : min(rank, dim)]
    low = project(emb, np.zeros(dim), top @ top.T).withColumnRenamed("v", "l")
    both = emb.join(low, "cell_id").select("cell_id", F.posexplode(F.arrays_zip("v", "l")).alias("i", "p")).select("cell_id", "i", "p.v", "p.l")
    cut = both.groupBy("i").agg(F.abs(F.percentile_approx("l", F.lit(quantile), F.lit(10_000))).alias("cut"))
    kept = both.join(F.broadcast(cut), "i").withColumn("a", F.when(F.col("l") > F.col("cut"), F.col("l")))  # a row a feature
    stats = kept.groupBy("i").agg(F.avg("a").alias("ma"), F.stddev("a").alias("sa"), F.avg(F.when(F.col("v") > 0, F.col("v"))).alias("mv"), F.stddev(F.when(F.col("v") > 0, F.col("v"))).alias("sv"))
    full = kept.join(F.broadcast(stats), "i")
    scaled = (F.col("a") - F.col("ma")) * F.coalesce(F.when(F.col("sa") > 0, F.col("sv") / F.col("sa")), F.lit(1.0)) + F.coalesce("mv", "ma")
    value = F.when(F.col("a").isNotNull(), F.greatest(F.lit(0.0), scaled)).when(F.col("v") > 0, F.col("v")).otherwise(0.0)
    return full.select("cell_id", "i", value.alias("x")).groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


def harmony(emb: DataFrame, batches_of: DataFrame, n_clusters: int = 8, rounds: int = 5, sigma: float = 0.1, ridge: float = 1.0, seed: int = 42) -> DataFrame:
    """cell_id, v with batch effects taken out: soft clusters on the unit sphere, then a ridge regression on batch in each cluster, in turns. batches_of:
    cell_id, batch. Sums by cluster and batch are all that reaches the driver."""
    rows = checkpointed(emb.join(batches_of.select("cell_id", F.col("batch").cast("string").alias("batch")), "cell_id"))
    names = sorted(r[0] for r in rows.select("batch").distinct().collect())
    share = dict(rows.groupBy("batch").agg((F.count(F.lit(1)) / rows.count()).alias("s")).collect())
    unit = rows.select(array_to_vector(F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(1e-12), lambda a, y: a + y * y)))).alias("features"))
    centres = np.array(KMeans(k=n_clusters, seed=seed).fit(unit).clusterCenters())
    dim, k, nb = len(rows.first().v), len(centres), len(names)
    kind = emb.schema["cell_id"].dataType.simpleString()
    shift = np.zeros((k, nb, dim))
    balance = np.ones((k, nb))

    def soft(v, batch, centres, balance):
        u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        c = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        r = np.exp(-2 * (1 - u @ c.T) / sigma) * balance[:, batch].T
        return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300), u

    # z: the corrected rows, by which rows are assigned; what is taken off is always found from, and taken off, the rows as they came
    now = rows.withColumn("z", F.col("v"))
    for _ in range(rounds):

        def sums(bs: Iterator[pd.DataFrame], centres=centres, balance=balance) -> Iterator[pd.DataFrame]:
            out = np.zeros((k, nb, 2 * dim + 1))
            for b in bs:
                if len(b):
                    v, z, batch = np.array(b["v"].tolist(), float), np.array(b["z"].tolist(), float), b["batch"].map(names.index).to_numpy()
                    r, u = soft(z, batch, centres, balance)
                    part = np.concatenate([v, u, np.ones((len(v), 1))], axis=1)
                    for j in range(nb):
                        out[:, j] += r[batch == j].T @ part[batch == j]
            yield pd.DataFrame({"s": [out.ravel()]})

        got = now.select("v", "z", "batch").mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy().reshape(k, nb, -1)  # clusters x batches
        size = got[:, :, -1]
        mean = got[:, :, :dim].sum(axis=1) / np.maximum(size.sum(axis=1), 1e-12)[:, None]
        shift = size[..., None] / (size[..., None] + ridge) * (got[:, :, :dim] / np.maximum(size, 1e-12)[..., None] - mean[:, None])
        expected = size.sum(axis=1, keepdims=True) * np.array([share[n] for n in names])
        before, balance = balance, np.clip((expected + 1) / (size + 1), 0.1, 10)

        def correct(bs: Iterator[pd.DataFrame], centres=centres, balance=before, shift=shift) -> Iterator[pd.DataFrame]:
            for b in bs:
                if len(b):
                    v, z, batch = np.array(b["v"].tolist(), float), np.array(b["z"].tolist(), float), b["batch"].map(names.index).to_numpy()
                    r, _ = soft(z, batch, centres, balance)
                    yield b.assign(z=list(v - np.einsum("nk,knd->nd", r, shift[:, batch])))[["cell_id", "v", "z", "batch"]]

        now = checkpointed(now.select("cell_id", "v", "z", "batch").mapInPandas(correct, f"cell_id {kind}, v array<double>, z array<double>, batch string"))
        centres = got[:, :, dim : 2 * dim].sum(axis=1)
    return now.select("cell_id", F.col("z").alias("v"))


