"""What the plots draw, as tables: coordinates and a feature, cut to a box and subsampled (max_cells None: every cell)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.operators.cells import feature_values, subsample

MAX_CELLS = 100_000


def in_box(df: DataFrame, xlim: tuple[float, float] | None = None, ylim: tuple[float, float] | None = None) -> DataFrame:
    """Rows within the limits that are given, ends included."""
    for name, limit in (("x", xlim), ("y", ylim)):
        if limit is not None:
            df = df.where(F.col(name).between(*limit))
    return df


def _drawn(rows: DataFrame, features: DataFrame, color_by: str, max_cells: int | None) -> DataFrame:
    rows = rows if max_cells is None else subsample(rows, max_cells)
    return rows.join(feature_values(rows, features, color_by), "cell_id")


def scatter(basis: DataFrame, features: DataFrame, color_by: str, max_cells: int | None = MAX_CELLS) -> DataFrame:
    """cell_id, x, y (the first two columns of basis beside the id, or of its vector v), value, categorical of at most max_cells cells."""
    at = [F.get("v", 0), F.get("v", 1)] if "v" in basis.columns and dict(basis.dtypes)["v"].startswith("array") else [F.col(c) for c in basis.columns if c != "cell_id"][:2]
    return _drawn(basis.select("cell_id", at[0].alias("x"), at[1].alias("y")), features, color_by, max_cells)


def spatial_scatter(cells: DataFrame, features: DataFrame, color_by: str, xlim=None, ylim=None, max_cells: int | None = MAX_CELLS) -> DataFrame:
    """cell_id, x, y, value, categorical of at most max_cells cells in the box."""
    return _drawn(in_box(cells.select("cell_id", "x", "y"), xlim, ylim), features, color_by, max_cells)


def spatial_polygons(shapes: DataFrame, features: DataFrame, color_by: str, xlim=None, ylim=None, max_cells: int | None = MAX_CELLS) -> DataFrame:
    """cell_id, ring, value, categorical of at most max_cells outlines; a box counts only with both limits, and takes outlines that meet it."""
    if xlim is not None and ylim is not None:
        shapes = shapes.where((F.col("x_max") >= xlim[0]) & (F.col("x_min") <= xlim[1]) & (F.col("y_max") >= ylim[0]) & (F.col("y_min") <= ylim[1]))
    return _drawn(shapes.select("cell_id", "ring"), features, color_by, max_cells)


def spatial_expression(places: DataFrame, expr: DataFrame, gene: str, mode: str = "scatter", **options) -> DataFrame:
    """spatial_scatter or spatial_polygons with a gene's counts as the feature; cells without a count have 0."""
    if mode not in ("scatter", "polygon"):
        raise ValueError("mode must be scatter or polygon")
    counts = expr.where(F.col("gene") == gene).select(F.col("cell").cast("string").alias("cell_id"), F.col("value").alias(gene))
    if counts.isEmpty():
        raise ValueError(f"no such gene: {gene}")
    drawn = (spatial_scatter if mode == "scatter" else spatial_polygons)(places, counts, gene, **options)
    return drawn.withColumn("value", F.coalesce("value", F.lit(0.0)))


def envelope(env: DataFrame) -> DataFrame:
    """What an envelope plot draws, of a table of dclf_envelope: cluster (as text), r, observed, lo, hi, theo, label ("cluster observed (p=...)")."""
    cluster = F.col("cluster").cast("string")
    return env.select(cluster.alias("cluster"), "r", "observed", "lo", "hi", "theo", F.format_string("%s observed (p=%.3f)", cluster, F.col("p_value")).alias("label"))
