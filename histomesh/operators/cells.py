"""Table operators on cells: projection, filters, tiles, batches, subsamples, coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("cell_id", "x", "y")


def _need(df: DataFrame, columns) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")


def validate(cells: DataFrame) -> DataFrame:
    """cells, if it has the required columns and unique ids."""
    _need(cells, REQUIRED)
    if not cells.groupBy("cell_id").count().where("count > 1").isEmpty():
        raise ValueError("cell_id is not unique")
    return cells


def select_columns(cells: DataFrame, columns: list[str]) -> DataFrame:
    _need(cells, columns)
    return cells.select(*columns)


def filter_equal(cells: DataFrame, **values) -> DataFrame:
    """Rows that equal every value given."""
    _need(cells, values)
    return cells.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in values.items()], F.lit(True)))


def within_bbox(cells: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float) -> DataFrame:
    """Rows in the box, its sides included."""
    if x_min >= x_max or y_min >= y_max:
        raise ValueError("empty box")
    return cells.where(F.col("x").between(x_min, x_max) & F.col("y").between(y_min, y_max))


def tiles(cells: DataFrame, size: float, overlap: float = 0.0) -> DataFrame:
    """Grid over the cells' bounding box, row by row, last ones clipped: tile, x_min.., and with overlap on each side n_cells. A box without
    extent is one tile."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap at least 0 and below size")
    box = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 is not null")
    n = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / size)).cast("long")
    box = box.withColumns({"nx": n("x0", "x1"), "ny": n("y0", "y1")})
    grid = box.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)).alias("ty")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("tx"))
    grid = grid.select(
        (F.col("ty") * F.col("nx") + F.col("tx")).alias("tile"), "tx", "ty", (F.col("x0") + F.col("tx") * size).alias("x_min"), (F.col("y0") + F.col("ty") * size).alias("y_min"),
        F.least("x1", F.col("x0") + (F.col("tx") + 1) * size).alias("x_max"), F.least("y1", F.col("y0") + (F.col("ty") + 1) * size).alias("y_max"),
    )
    near = lambda c, lo, top: F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((F.col(c) - F.col(lo) - overlap) / size) - 1), F.least(F.col(top) - 1, F.floor((F.col(c) - F.col(lo) + overlap) / size))))
    at = cells.crossJoin(F.broadcast(box)).select("x", "y", "x0", "y0", "nx", "ny")  # box is one row
    at = at.select("x", "y", "x0", "y0", "nx", "ny", near("x", "x0", "nx").alias("tx")).select("x", "y", "nx", "tx", near("y", "y0", "ny").alias("ty"))
    counts = at.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n_cells"))
    return grid.join(counts, ["tx", "ty"], "left").select("tile", "x_min", "y_min", "x_max", "y_max", F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))


def batches(cells: DataFrame, size: int, order: str = "cell_idx") -> DataFrame:
    """cells with batch, by runs of size rows of the index column."""
    if size <= 0:
        raise ValueError("size must be positive")
    return cells.withColumn("batch", F.floor(F.col(order) / size).cast("long"))


def subsample(cells: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if there are no more), the same each time: those with the least seeded hash of their id. The hash up to which they go is found from
    counts by its prefix, so that only the rows of one prefix are ranked."""
    if n <= 0:
        return cells.limit(0)
    h = F.xxhash64(F.lit(seed), "cell_id")
    p = F.shiftright(h, 48)
    counts = cells.groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("m"))
    cut = counts.withColumn("upto", F.sum("m").over(Window.orderBy("p"))).where((F.col("upto") >= n) & (F.col("upto") - F.col("m") < n)).first()  # at most 65536 rows
    if cut is None:
        return cells
    rest = cells.where(p == cut.p).orderBy(h, "cell_id").limit(n - (cut.upto - cut.m))
    return cells.where(p < cut.p).union(rest)


def add_column(cells: DataFrame, values: DataFrame, name: str, key: str = "cell_id") -> DataFrame:
    """cells with the column name of values, which must hold each key once (cells without one get null)."""
    if not values.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return cells.join(values.select(key, name), key, "left")


def um_to_px(um, pixel_size: float, level: int = 0):
    """Pixels at a pyramid level, halves to even."""
    _check_scale(pixel_size, level)
    return F.bround(um / (pixel_size * 2**level)).cast("long")


def _check_scale(pixel_size: float, level: int) -> None:
    if pixel_size <= 0 or level < 0:
        raise ValueError("pixel_size must be positive, level at least 0")


def px_to_um(px, pixel_size: float, level: int = 0):
    _check_scale(pixel_size, level)
    return px * (pixel_size * 2**level)


def scale_coordinates(cells: DataFrame, pixel_size: float, level: int = 0) -> DataFrame:
    _check_scale(pixel_size, level)
    scale = pixel_size * 2**level
    return cells.withColumns({"x": F.col("x") / scale, "y": F.col("y") / scale})


def feature_values(cells: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """cell_id, value, categorical (text, or whole numbers of fewer than 20 kinds) for every cell; null where the table has none."""
    kind = dict(table.dtypes)[column]
    few = F.lit(kind in ("string", "boolean"))
    out = cells.select("cell_id").join(table.select("cell_id", F.col(column).alias("value")), "cell_id", "left")
    if kind in ("int", "bigint", "smallint", "tinyint"):
        few = F.lit(table.agg(F.count_distinct(column)).first()[0] < 20)
    return out.withColumn("categorical", few)


def ranked(df: DataFrame, partition: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each partition."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rank") <= n)
