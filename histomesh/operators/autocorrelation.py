"""Moran's I, Geary's C and Getis-Ord statistics over binary spatial weights.

Everything comes from three aggregates: powers of deviations over nodes, products or differences over edges, squared degrees. variance
"compat" uses W for the first weight moment (half of the textbook's); "textbook" uses the published form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.functions.mathx import two_sided
from histomesh.operators.graphs import both_ways


def _nodes(edges: DataFrame, values: DataFrame, domain: str) -> DataFrame:
    """cell_id, feature, v, degree. domain: "graph" (nodes of the graph) or "table" (rows of values)."""
    degree = both_ways(edges).groupBy("cell_id").agg(F.count(F.lit(1)).alias("degree"))
    return values.join(degree, "cell_id", "inner" if domain == "graph" else "left").na.fill(0, ["degree"])


def one_hot(clusters: DataFrame) -> DataFrame:
    """cell_id, feature, v: an indicator column for every cluster, long."""
    names = clusters.select(F.col("cluster").alias("feature")).distinct()
    return clusters.crossJoin(F.broadcast(names)).select("cell_id", "feature", (F.col("cluster") == F.col("feature")).cast("double").alias("v"))  # clusters are few


def _parts(edges: DataFrame, values: DataFrame, domain: str) -> DataFrame:
    """Per feature: n, m2 and m4 (sums of powers of deviations), s2 (squares of doubled degrees), w (directed edges), cross (z_a z_b), diff ((x_a - x_b)^2), both over directed edges."""
    nodes = _nodes(edges, values, domain)
    mean = nodes.groupBy("feature").agg(F.avg("v").alias("mean"))
    z = nodes.join(F.broadcast(mean), "feature").withColumn("z", F.col("v") - F.col("mean"))  # a row a feature
    sums = z.groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.pow("z", 2)).alias("m2"), F.sum(F.pow("z", 4)).alias("m4"))
    end = lambda c, name: z.select(F.col("cell_id").alias(c), "feature", F.col("z").alias(name))
    pairs = edges.select("cell_id_a", "cell_id_b").join(end("cell_id_a", "za"), "cell_id_a").join(end("cell_id_b", "zb").withColumnRenamed("feature", "f2"), "cell_id_b").where("feature = f2")
    over = pairs.groupBy("feature").agg((2.0 * F.count(F.lit(1))).alias("w"), (2 * F.sum(F.col("za") * F.col("zb"))).alias("cross"), (2 * F.sum(F.pow(F.col("za") - F.col("zb"), 2))).alias("diff"))
    ends = pairs.select("feature", F.explode(F.array("cell_id_a", "cell_id_b")).alias("c")).groupBy("feature", "c").agg(F.count(F.lit(1)).alias("k"))
    s2 = ends.groupBy("feature").agg(F.sum(F.pow(2.0 * F.col("k"), 2)).alias("s2"))
    return sums.join(over, "feature", "left").join(s2, "feature", "left").na.fill(0.0)


def _finish(parts: DataFrame, name: str, start: float, value, expected, variance, variant: str) -> DataFrame:
    flat = (F.col("n") < 3) | (F.col("m2") == 0) | (F.col("w") == 0)
    out = parts.withColumns({"s1": F.col("w") * (2 if variant == "textbook" else 1), "k": F.when(flat, 0.0).otherwise(F.col("n") * F.col("m4") / (F.col("m2") * F.col("m2")))})
    out = out.withColumns({"value": value, "e": expected}).withColumn("var", F.greatest(variance, F.lit(1e-15)))
    # three nodes have no variance: the formula divides by n - 3
    z = F.when(F.col("n") == 3, F.lit(float("nan"))).otherwise((F.col("value") - F.col("e")) / F.sqrt("var"))
    out = out.withColumn("z", z)
    pick = lambda c, v: F.when(flat, v).otherwise(c)
    return out.select(
        "feature", pick(F.col("value"), start).alias(name), pick(F.col("e"), start).alias(f"expected_{name}"), pick(F.col("z"), 0.0).alias("z_score"),
        pick(F.when(F.isnan("z"), F.col("z")).otherwise(two_sided(F.col("z"))), 1.0).alias("p_value"),
    )


def _safe(n, d):
    return F.when(d != 0, n / d)


def morans_i(edges: DataFrame, values: DataFrame, domain: str = "graph", variance: str = "compat") -> DataFrame:
    """values: cell_id, feature, v. Returns feature, I, expected_I, z_score, p_value (randomisation variance, two-sided normal)."""
    return moran_of(_parts(edges, values, domain), variance)


def moran_of(parts: DataFrame, variance: str = "compat") -> DataFrame:
    n, w, s1, s2, k = (F.col(c) for c in ("n", "w", "s1", "s2", "k"))
    top = n * (s1 * (n * n - 3 * n + 3) - n * s2 + 3 * w * w) - k * (s1 * (n * n - n) - 2 * n * s2 + 6 * w * w)
    e = _safe(F.lit(-1.0), n - 1)
    var = _safe(top, (n - 1) * (n - 2) * (n - 3) * w * w) - e * e
    return _finish(parts, "I", 0.0, _safe(n * F.col("cross"), w * F.col("m2")), e, var, variance)


def gearys_c(edges: DataFrame, values: DataFrame, domain: str = "graph", variance: str = "compat") -> DataFrame:
    """feature, C, expected_C (1), z_score, p_value. "textbook" divides the variance by n (n - 2)(n - 3) W^2."""
    return geary_of(_parts(edges, values, domain), variance)


def geary_of(parts: DataFrame, variance: str = "compat") -> DataFrame:
    n, w, s1, s2, k = (F.col(c) for c in ("n", "w", "s1", "s2", "k"))
    top = (n - 1) * s1 * (n * n - 3 * n + 3 - (n - 1) * k) - (n - 1) * s2 * (n * n + 3 * n - 6 - (n * n - n + 2) * k) / 4 + w * w * (n * n - 3 - (n - 1) * (n - 1) * k)
    var = _safe(top, (n if variance == "textbook" else n - 1) * (n - 2) * (n - 3) * w * w)
    return _finish(parts, "C", 1.0, _safe((n - 1) * F.col("diff"), 2 * w * F.col("m2")), F.lit(1.0), var, variance)


def getis_ord(edges: DataFrame, values: DataFrame, star: bool = True) -> DataFrame:
    """values: cell_id, v (numbers). Gi* (star: a node neighbours itself) or Gi of every graph node, with p-values."""
    if dict(values.dtypes)["v"] in ("string", "boolean"):
        raise ValueError("Getis-Ord needs numbers")
    way = both_ways(edges)
    nodes = way.select("cell_id").distinct().join(values, "cell_id")
    sums = way.join(nodes.select(F.col("cell_id").alias("other"), F.col("v").alias("ov")), "other").groupBy("cell_id").agg(F.count(F.lit(1)).alias("k"), F.sum("ov").alias("s"))
    whole = nodes.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    own = 1 if star else 0
    return scored(nodes.join(sums, "cell_id").crossJoin(F.broadcast(whole)).withColumns({"w": F.col("k") + own, "t": F.col("s") + own * F.col("v")}))  # one row


def scored(out: DataFrame) -> DataFrame:
    """cell_id, gi_stat, p_value of cell_id, w and t (number and sum of a node's neighbours) and n, mean, sd of all nodes."""
    bottom = F.col("sd") * F.sqrt((F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1))
    stat = F.when(F.col("sd") == 0, 0.0).otherwise((F.col("t") - F.col("mean") * F.col("w")) / F.when(bottom == 0, 1e-15).otherwise(bottom))
    out = out.withColumn("gi_stat", stat)
    return out.select("cell_id", "gi_stat", F.when(F.col("sd") == 0, 1.0).otherwise(two_sided(F.col("gi_stat"))).alias("p_value"))
