"""Expression transforms over sparse long tables (cell, gene, value): zeros are not stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalize_total(expr: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """Values scaled so that each cell sums to target_sum; a cell that sums to 0 stays. Zeros stay zeros, so the table stays sparse."""
    total = F.sum("value").over(Window.partitionBy("cell"))
    return expr.withColumn("value", F.col("value") / F.when(total == 0, 1.0).otherwise(total) * target_sum)


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def n_cells(expr: DataFrame) -> int:
    return expr.select("cell").distinct().count()


def moments(expr: DataFrame, n: int) -> DataFrame:
    """gene, mean, variance (sample) over n cells, the unstored zeros included."""
    sums = expr.groupBy("gene").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    mean = F.col("s1") / n
    return sums.select("gene", mean.alias("mean"), F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * mean) / max(1, n - 1)).alias("variance"))


def highly_variable_genes(expr: DataFrame, n_top: int = 2000, n: int | None = None) -> DataFrame:
    """gene, mean, variance, dispersion (variance over mean, 0 for mean <= 0), highly_variable: the n_top most dispersed, ties by name."""
    stats = moments(expr, n or n_cells(expr)).withColumn("dispersion", F.when(F.col("mean") > 0, F.col("variance") / F.col("mean")).otherwise(0.0))
    rank = F.row_number().over(Window.orderBy(F.desc("dispersion"), "gene"))  # one row a gene
    return stats.withColumn("highly_variable", rank <= n_top)


def scale(expr: DataFrame, genes: DataFrame, max_value: float = 10.0, n: int | None = None) -> DataFrame:
    """Dense cell x gene table of (value - mean) / sd (sample; 0 counts as 1), clipped, for the genes given."""
    stats = moments(expr, n or n_cells(expr)).join(genes.select("gene"), "gene")
    grid = expr.select("cell").distinct().crossJoin(F.broadcast(stats))  # a row a gene: bounded by the panel
    z = (F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0)
    return grid.join(expr, ["cell", "gene"], "left").select("cell", "gene", F.greatest(F.lit(-max_value), F.least(F.lit(max_value), z)).alias("value"))


def pearson_residuals(expr: DataFrame, theta: float = 100.0) -> DataFrame:
    """Dense table of (x - mu) / sqrt(mu + mu^2 / theta), clipped at the square root of the number of cells; NaN where mu is 0."""
    rows, genes = expr.groupBy("cell").agg(F.sum("value").alias("n")), expr.groupBy("gene").agg(F.sum("value").alias("g"))
    total = expr.agg(F.sum("value").alias("t"), F.sqrt(F.count_distinct("cell").cast("double")).alias("top"))
    grid = rows.crossJoin(F.broadcast(genes)).crossJoin(F.broadcast(total))  # a row a gene, and one row
    grid = grid.join(expr, ["cell", "gene"], "left").withColumn("mu", F.col("n") * F.col("g") / F.col("t"))
    res = (F.coalesce("value", F.lit(0.0)) - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") * F.col("mu") / theta)
    clipped = F.when(F.col("mu") == 0, F.lit(float("nan"))).otherwise(F.greatest(-F.col("top"), F.least("top", res)))
    return grid.select("cell", "gene", clipped.alias("value"))


def select_genes(expr: DataFrame, genes: list[str]) -> DataFrame:
    """The entries of the genes given, with pos, their place in the list; a gene listed twice comes twice, one without any entry raises."""
    wanted = expr.sparkSession.createDataFrame([(g, k) for k, g in enumerate(genes)], f"gene {expr.schema['gene'].dataType.simpleString()}, pos long")
    if not wanted.join(expr.select("gene").distinct(), "gene", "left_anti").isEmpty():
        raise ValueError("no such genes")
    return expr.join(F.broadcast(wanted), "gene")  # as long as the caller's list


def select_cells(expr: DataFrame, cells: list) -> DataFrame:
    """The rows of the cells given, with pos, their place in the list; a cell listed twice comes twice, an unknown one raises."""
    wanted = expr.sparkSession.createDataFrame([(c, k) for k, c in enumerate(cells)], f"cell {expr.schema['cell'].dataType.simpleString()}, pos long")
    if not wanted.join(expr.select("cell").distinct(), "cell", "left_anti").isEmpty():
        raise ValueError("no such cells")
    return expr.join(F.broadcast(wanted), "cell")  # as long as the caller's list


def by_cluster(expr: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, gene, mean and expressing share over all cells of the cluster (unstored zeros included)."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = expr.join(clusters, "cell").groupBy("cluster", "gene").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    grid = sizes.crossJoin(F.broadcast(expr.select("gene").distinct()))  # clusters x genes
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return grid.join(sums, ["cluster", "gene"], "left").select("cluster", "gene", (zero("s") / F.col("n")).alias("mean"), (zero("k") / F.col("n")).alias("share"))


def heatmap(expr: DataFrame, clusters: DataFrame) -> DataFrame:
    """by_cluster's means as z-scores by gene over clusters (population sd; 0 counts as 1)."""
    w = Window.partitionBy("gene")
    sd = F.stddev_pop("mean").over(w)
    return by_cluster(expr, clusters).select("cluster", "gene", "mean", ((F.col("mean") - F.avg("mean").over(w)) / F.when(sd == 0, 1.0).otherwise(sd)).alias("z"))


def quantiles(expr: DataFrame, clusters: DataFrame, at=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles of the stored values by cluster and gene."""
    cols = [F.percentile("value", F.lit(float(q))).alias(f"q{int(100 * q)}") for q in at]
    return expr.join(clusters, "cell").groupBy("cluster", "gene").agg(*cols)
