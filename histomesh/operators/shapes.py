"""Cell outlines: measures, queries and contacts. Polygons are (cell_id, ring): a closed ring as array<struct<x, y>>; a column rest, if there is one,
holds further rings (holes, clockwise, and outer rings of other parts, counter-clockwise, as sources.wkb gives them). Measures and relations
take all rings; what describes one outline (hull, rectangle, ellipse, box counts, number of vertices) takes ring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names of the measures and predicates.
METRICS = "area perimeter centroid_x centroid_y circularity elongation aspect_ratio solidity eccentricity fractal_dimension vertex_count convexity_defects rectangularity".split()
PREDICATES = ("intersects", "within", "contains", "overlaps", "covers", "covered_by")


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))


def all_rings(shapes: DataFrame) -> Column:
    """array<ring> of every row: ring, then rest."""
    return F.concat(F.array("ring"), F.coalesce("rest", F.array().cast(dict(shapes.dtypes)["rest"]))) if "rest" in shapes.columns else F.array("ring")


def with_bbox(shapes: DataFrame) -> DataFrame:
    every = F.flatten(all_rings(shapes))
    side = lambda f, c: f(F.transform(every, lambda p: p[c]))
    return shapes.withColumns({"x_min": side(F.array_min, "x"), "y_min": side(F.array_min, "y"), "x_max": side(F.array_max, "x"), "y_max": side(F.array_max, "y")})


def scale_polygons(shapes: DataFrame, pixel_size: float, level: int = 0) -> DataFrame:
    """shapes in pixels of a pyramid level, their boxes too."""
    if pixel_size <= 0 or level < 0:
        raise ValueError("pixel_size must be positive, level at least 0")
    scale = pixel_size * 2**level
    one = lambda r: F.transform(r, lambda p: F.struct((p["x"] / scale).alias("x"), (p["y"] / scale).alias("y")))
    out = shapes.withColumn("ring", one(F.col("ring")))
    if "rest" in shapes.columns:
        out = out.withColumn("rest", F.transform("rest", one))
    return out.withColumns({c: F.col(c) / scale for c in ("x_min", "y_min", "x_max", "y_max") if c in shapes.columns})


def query_bbox(shapes: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float) -> DataFrame:
    """Shapes (with bbox columns) whose box meets the box given, sides included."""
    if x_min >= x_max or y_min >= y_max:
        raise ValueError("empty box")
    return shapes.where((F.col("x_max") >= x_min) & (F.col("x_min") <= x_max) & (F.col("y_max") >= y_min) & (F.col("y_min") <= y_max))


def cell_by_id(shapes: DataFrame, cell_id: str) -> DataFrame:
    found = shapes.where(F.col("cell_id") == cell_id)
    if found.isEmpty():
        raise KeyError(cell_id)
    return found


class Edges:
    """The edges of a polygon's rings: a (starts) and b (ends), n x 2. No ring is joined to the next."""

    def __init__(self, rings):
        rings = [np.asarray(r, float) for r in rings]
        self.a, self.b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])


def _edges(rings) -> Edges:
    """Of a row's rings as Arrow gives them."""
    return Edges([[(p["x"], p["y"]) for p in r] for r in rings])


def inside(points: np.ndarray, e: Edges) -> np.ndarray:
    """Points strictly inside or (by luck of the ray) on an edge; holes are outside."""
    a, b = e.a, e.b
    x, y = points[:, :1], points[:, 1:]
    crosses = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return (crosses & (x < at)).sum(axis=1) % 2 == 1


def on_edge(points: np.ndarray, e: Edges, tolerance: float = 1e-9) -> np.ndarray:
    return edge_distance(points, e) <= tolerance


def edge_distance(points: np.ndarray, e: Edges) -> np.ndarray:
    d = e.b - e.a
    length = np.maximum((d * d).sum(axis=1), 1e-300)
    t = np.clip(((points[:, None] - e.a) * d).sum(axis=2) / length, 0, 1)
    return np.sqrt((((e.a + t[..., None] * d) - points[:, None]) ** 2).sum(axis=2)).min(axis=1)


def _meetings(a: Edges, b: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every edge of a (rows) and of b (columns): whether they are parallel, where a's and b's lines meet as shares of the edges (only where
    they are not), and the length they have in common (-1 where none meets; parallel ones only)."""
    d, e = (a.b - a.a)[:, None], (b.b - b.a)[None]
    off, end = b.a[None] - a.a[:, None], b.b[None] - a.a[:, None]
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    turn, size = cross(d, e), np.hypot(d[..., 0], d[..., 1])
    flat = np.abs(turn) <= 1e-12 * size * np.hypot(e[..., 0], e[..., 1])
    safe, unit = np.where(flat, 1.0, turn), np.maximum(size, 1e-300)
    t, u = cross(off, e) / safe, cross(off, d) / safe
    p, q = (off * d).sum(axis=2) / unit, (end * d).sum(axis=2) / unit
    common = np.minimum(size, np.maximum(p, q)) - np.maximum(0.0, np.minimum(p, q))
    common = np.where(flat & (size > 0) & (np.abs(cross(d, off)) <= 1e-9 * size) & (common >= 0), common, -1.0)
    return flat | (size == 0), t, u, common


def _cut_length(a: Edges, b: Edges) -> tuple[float, bool, bool]:
    """(length of a's edges along b's edges, whether edges meet at all, whether they cross properly)."""
    flat, t, u, common = _meetings(a, b)
    within = lambda by: ~flat & (t >= -by) & (t <= 1 + by) & (u >= -by) & (u <= 1 + by)
    return float(common[common > 0].sum()), bool(within(1e-12).any() or (common >= 0).any()), bool(within(-1e-12).any())


def relation(query: Edges, cell: Edges, predicate: str) -> bool:
    """predicate(query, cell)."""
    _, meets, crosses = _cut_length(query, cell)
    mids = lambda r: np.vstack([r.a, (r.a + r.b) / 2])
    q, c = mids(query), mids(cell)
    q_in, q_on = inside(q, cell), on_edge(q, cell)
    c_in, c_on = inside(c, query), on_edge(c, query)
    q_deep, c_deep = (q_in & ~q_on).any(), (c_in & ~c_on).any()
    touch = meets or q_in.any() or c_in.any()
    cell_covered = not crosses and bool((c_in | c_on).all()) and not q_deep
    query_covered = not crosses and bool((q_in | q_on).all()) and not c_deep
    if predicate == "intersects":
        return bool(touch)
    if predicate in ("contains", "covers"):
        return cell_covered
    if predicate in ("within", "covered_by"):
        return query_covered
    if predicate == "overlaps":
        return bool(crosses or q_deep or c_deep) and not cell_covered and not query_covered
    raise ValueError(f"predicate must be one of {PREDICATES}")


def query_polygon(shapes: DataFrame, polygon: list[tuple[float, float]], predicate: str = "intersects") -> DataFrame:
    """Shapes (with bbox columns) for which predicate(polygon, shape) holds; boxes are compared first, in the scan."""
    if predicate not in PREDICATES:
        raise ValueError(f"predicate must be one of {PREDICATES}")
    own = Edges([polygon if polygon[0] == polygon[-1] else [*polygon, polygon[0]]])
    (x0, y0), (x1, y1) = own.a.min(axis=0), own.a.max(axis=0)

    @F.pandas_udf("boolean")
    def holds(rings: pd.Series) -> pd.Series:
        return pd.Series([relation(own, _edges(r), predicate) for r in rings], dtype=bool)

    return query_bbox(shapes, float(x0), float(y0), float(x1), float(y1)).where(holds(all_rings(shapes)))


def query_radius(shapes: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Shapes (with bbox columns) within radius of the point, exactly: distance to the polygon, 0 inside."""
    if radius <= 0:
        raise ValueError("radius must be positive")

    @F.pandas_udf("boolean")
    def near(rings: pd.Series) -> pd.Series:
        at = np.array([[x, y]])
        return pd.Series([bool(inside(at, e)[0] or edge_distance(at, e)[0] <= radius) for e in map(_edges, rings)], dtype=bool)

    return query_bbox(shapes, x - radius, y - radius, x + radius, y + radius).where(near(all_rings(shapes)))


def _candidates(shapes: DataFrame, width: float, margin: float) -> DataFrame:
    """Pairs a < b whose boxes, widened by margin, meet; each once, in the tile that holds the larger of the lower left corners."""
    wide = lambda c, sign: F.floor((F.col(c) + sign * margin) / width)
    tiled = shapes.withColumn("tx", F.explode(F.sequence(wide("x_min", -1), wide("x_max", 1)))).withColumn("ty", F.explode(F.sequence(wide("y_min", -1), wide("y_max", 1))))
    tiled = tiled.withColumn("rings", all_rings(shapes))
    cols = ["cell_id", "rings", "x_min", "y_min", "x_max", "y_max"]
    a = tiled.select("tx", "ty", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = tiled.select("tx", "ty", *[F.col(c).alias(f"{c}_b") for c in cols])
    m = 2 * margin
    meet = (F.col("x_min_a") - m <= F.col("x_max_b")) & (F.col("x_min_b") - m <= F.col("x_max_a")) & (F.col("y_min_a") - m <= F.col("y_max_b")) & (F.col("y_min_b") - m <= F.col("y_max_a"))
    home = (F.col("tx") == F.floor((F.greatest("x_min_a", "x_min_b") - margin) / width)) & (F.col("ty") == F.floor((F.greatest("y_min_a", "y_min_b") - margin) / width))
    return a.join(b, ["tx", "ty"]).where((F.col("cell_id_a") < F.col("cell_id_b")) & meet & home)


def tile_width(shapes: DataFrame) -> float:
    w = shapes.agg(F.avg(F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")))).first()[0]
    return max(2 * (w or 1.0), 1e-9)


def box_contact_graph(boxes: DataFrame) -> DataFrame:
    """cell_id_a, cell_id_b, shared_length of axis-parallel boxes (with bbox columns) that meet: the length of the common edge, or the perimeter
    of the common area."""
    pairs = _candidates(boxes, tile_width(boxes), 0.0)
    w = F.least("x_max_a", "x_max_b") - F.greatest("x_min_a", "x_min_b")
    h = F.least("y_max_a", "y_max_b") - F.greatest("y_min_a", "y_min_b")
    return pairs.withColumns({"w": w, "h": h}).where("w >= 0 and h >= 0").select("cell_id_a", "cell_id_b", F.when((F.col("w") > 0) & (F.col("h") > 0), 2 * (F.col("w") + F.col("h"))).otherwise(F.greatest("w", "h")).alias("shared_length"))


def _along(a: Edges, b: Edges) -> float:
    """Length of a's edges that lies inside b's area."""
    flat, t, u, _ = _meetings(a, b)
    hit = ~flat & (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)
    # every edge cut where it meets one of b, the middles of the pieces looked up at once
    row, col = np.nonzero(hit)
    edge = np.concatenate([np.arange(len(a.a)), row, np.arange(len(a.a))])
    at = np.concatenate([np.zeros(len(a.a)), t[row, col], np.ones(len(a.a))])
    order = np.lexsort((at, edge))
    edge, at = edge[order], at[order]
    same = edge[1:] == edge[:-1]
    edge, lo, hi = edge[:-1][same], at[:-1][same], at[1:][same]
    d = a.b - a.a
    mids = a.a[edge] + d[edge] * ((lo + hi) / 2)[:, None]
    deep = inside(mids, b) & ~on_edge(mids, b)
    return float((np.hypot(d[edge, 0], d[edge, 1]) * (hi - lo) * deep).sum())


def contact_graph(shapes: DataFrame, buffer_distance: float = 0.0) -> DataFrame:
    """cell_id_a, cell_id_b, shared_length of polygons (with bbox columns) that meet, or lie within twice the buffer. shared_length: of the common
    edge, 0 for a point, the perimeter of the common area where they overlap."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, ra, rb in zip(batch["cell_id_a"], batch["cell_id_b"], batch["rings_a"], batch["rings_b"], strict=True):
                x, y = _edges(ra), _edges(rb)
                edge, meets, _ = _cut_length(x, y)
                deep = _along(x, y) + _along(y, x)
                if meets or deep or inside(x.a, y).any() or inside(y.a, x).any():
                    out.append((a, b, deep + edge))
                elif buffer_distance > 0 and min(edge_distance(x.a, y).min(), edge_distance(y.a, x).min()) <= 2 * buffer_distance:
                    out.append((a, b, 0.0))
            yield pd.DataFrame(out, columns=["cell_id_a", "cell_id_b", "shared_length"])

    pairs = _candidates(shapes, tile_width(shapes), buffer_distance).select("cell_id_a", "cell_id_b", "rings_a", "rings_b")
    return pairs.mapInPandas(work, "cell_id_a string, cell_id_b string, shared_length double")


def _with_measures(shapes: DataFrame) -> DataFrame:
    """shapes with the measures that are sums over edges or vertices, as columns named after them."""
    pairs = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    add = lambda f: F.aggregate("edges", F.lit(0.0), lambda acc, e: acc + f(e))
    rows = with_bbox(shapes).withColumn("edges", F.flatten(F.transform(all_rings(shapes), pairs)))
    rows = rows.withColumns({
        "twice": add(cross), "perimeter": add(lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])),
        "sx": add(lambda e: (e["p"]["x"] + e["q"]["x"]) * cross(e)), "sy": add(lambda e: (e["p"]["y"] + e["q"]["y"]) * cross(e)),
    })
    area, box = F.abs("twice") / 2, (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    return rows.withColumns({
        "area": area, "centroid_x": F.col("sx") / (3 * F.col("twice")), "centroid_y": F.col("sy") / (3 * F.col("twice")),
        "circularity": F.when(F.col("perimeter") > 0, 4 * math.pi * area / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0),
        "vertex_count": (F.size("ring") - 1).cast("long"), "rectangularity": F.when(box > 0, area / box).otherwise(0.0),
    })


def ring_measures(shapes: DataFrame) -> DataFrame:
    """The measures that are sums over edges or vertices: cell_id, area, perimeter, centroid_x, centroid_y, circularity, vertex_count, rectangularity."""
    return _with_measures(shapes).select("cell_id", "area", "perimeter", "centroid_x", "centroid_y", "circularity", "vertex_count", "rectangularity")


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return np.array(pts)

    def chain(run):
        out = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def ring_area(ring: np.ndarray) -> float:
    a, b = ring, np.roll(ring, -1, axis=0)
    return abs(float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum())) / 2


def smallest_rectangle(h: np.ndarray) -> tuple[float, float]:
    """Sides (longer first) of the least-area rectangle around a hull: one of its edges lies along it."""
    if len(h) < 3:
        return (float(np.hypot(*(h[-1] - h[0]))) if len(h) else 0.0), 0.0
    e = np.roll(h, -1, axis=0) - h
    angle = np.arctan2(e[:, 1], e[:, 0])
    c, s = np.cos(angle), np.sin(angle)
    u, v = np.outer(c, h[:, 0]) + np.outer(s, h[:, 1]), np.outer(c, h[:, 1]) - np.outer(s, h[:, 0])
    w, t = np.ptp(u, axis=1), np.ptp(v, axis=1)
    k = int(np.argmin(w * t))
    return max(w[k], t[k]), min(w[k], t[k])


def eccentricity(points: np.ndarray) -> float:
    """Of the least-squares ellipse through the vertices (general conic, centred for stability); 0 below five vertices or where no ellipse fits."""
    if len(points) < 5:
        return 0.0
    p = points - points.mean(axis=0)
    p = p / max(np.abs(p).max(), 1e-12)
    x, y = p.T
    sol, *_ = np.linalg.lstsq(np.column_stack([x * x, x * y, y * y, x, y]), np.ones(len(p)), rcond=None)
    lo, hi = np.linalg.eigvalsh([[sol[0], sol[1] / 2], [sol[1] / 2, sol[2]]])
    return float(np.sqrt(max(0.0, 1 - lo / hi))) if lo > 0 else 0.0


def fractal_dimension(points: np.ndarray) -> float:
    """Box counting of the vertices in the unit square (each axis by its own span), boxes of 1/2 to 1/128; 1 at least, and below four vertices."""
    if len(points) < 4:
        return 1.0
    span = np.ptp(points, axis=0)
    unit = (points - points.min(axis=0)) / np.where(span == 0, 1.0, span)
    k = np.arange(1, 8)
    n = [len(np.unique(np.floor(unit * 2**i).astype(int), axis=0)) for i in k]
    return max(1.0, float(np.polyfit(k * math.log(2), np.log(n), 1)[0]))


def cell_morphology(shapes: DataFrame) -> DataFrame:
    """cell_id and the METRICS of every polygon, in one pass. What needs hulls, rectangles and fits runs in Arrow batches; the rest is column arithmetic."""

    @F.pandas_udf("elongation double, aspect_ratio double, solidity double, eccentricity double, fractal_dimension double, convexity_defects double")
    def fitted(ring: pd.Series, area: pd.Series) -> pd.DataFrame:
        out = []
        for r, own in zip(ring, area, strict=True):
            pts = np.array([(p["x"], p["y"]) for p in r])[:-1]
            h = hull(pts)
            big = ring_area(h) if len(h) > 2 else 0.0
            major, minor = smallest_rectangle(h)
            out.append((1 - minor / major if major else 0.0, major / minor if minor else 1.0, own / big if big else 1.0, eccentricity(pts), fractal_dimension(pts), big - own))
        return pd.DataFrame(out, columns=["elongation", "aspect_ratio", "solidity", "eccentricity", "fractal_dimension", "convexity_defects"])

    rows = _with_measures(shapes).withColumn("fitted", fitted("ring", "area"))
    return rows.select(*[F.col(f"fitted.{c}" if c not in rows.columns else c).alias(c) for c in METRICS_OF])


METRICS_OF = ("cell_id", *METRICS)
