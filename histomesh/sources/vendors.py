"""Readers of vendor output directories. Each returns DataFrames: cells, expression as (cell, gene, value), boundaries as (cell_id, ring), images as a registry."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histomesh.sources.wkb import decode

# Columns of the vendors' files and the names used here.
XENIUM = {"x_centroid": "x", "y_centroid": "y", "cell_area": "area", "fov_name": "fov_id"}
MERSCOPE = {
    "EntityID": "cell_id", "center_x": "x", "center_y": "y", "center_z": "z_centroid", "fov": "fov_id",
    "min_x": "x_min", "max_x": "x_max", "min_y": "y_min", "max_y": "y_max",
}
PIXEL_SIZE = 0.2125


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def text_of(spark: SparkSession, path: str) -> str | None:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) if exists(spark, path) else None


def canonical(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """df with the columns it has of mapping renamed and cell_id as text."""
    df = df.withColumnsRenamed(mapping)
    if "cell_id" not in df.columns:
        raise KeyError("cell_id")
    return df.withColumn("cell_id", F.col("cell_id").cast("string"))


def xenium_cells(spark: SparkSession, src: str) -> DataFrame:
    for name in ("cells.parquet", "cells.csv.gz"):
        if exists(spark, path := f"{src}/{name}"):
            return canonical(spark.read.parquet(path) if name.endswith("parquet") else spark.read.csv(path, header=True, inferSchema=True), XENIUM)
    raise FileNotFoundError(f"{src}: no cells.parquet or cells.csv.gz")


def matrix_market(spark: SparkSession, folder: str) -> DataFrame:
    """cell, gene, value of a 10x folder (genes x cells in matrix.mtx.gz; the gene's name is the second column of features.tsv.gz). Counts stay exact and sparse."""

    def numbered(name: str, column: int) -> DataFrame:
        lines = spark.read.text(f"{folder}/{name}", wholetext=True).select(F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\r?\n")).alias("i", "line"))
        return lines.select((F.col("i") + 1).alias("i"), F.get(F.split("line", "\t"), column).alias("name"))

    rows = spark.read.text(f"{folder}/matrix.mtx.gz").where(~F.startswith("value", F.lit("%"))).select(F.split(F.trim("value"), r"\s+").alias("p"))
    # the first line without % gives the dimensions: as the only one, its place in the file is the first
    rows = rows.withColumn("k", F.monotonically_increasing_id())
    first = rows.agg(F.min("k").alias("first"))
    rows = rows.crossJoin(F.broadcast(first)).where("k <> first").select(F.get("p", 0).cast("int").alias("g"), F.get("p", 1).cast("int").alias("c"), F.get("p", 2).cast("double").alias("value"))
    genes, cells = numbered("features.tsv.gz", 1), numbered("barcodes.tsv.gz", 0)
    named = rows.join(genes.select(F.col("i").alias("g"), F.col("name").alias("gene")), "g").join(cells.select(F.col("i").alias("c"), F.col("name").alias("cell")), "c")
    return named.where("value <> 0").select("cell", "gene", "value")


def _lines(spark: SparkSession, path: str, column: int, name: str) -> DataFrame:
    """name, name_idx: a column of a tab-separated file, by line from 0."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\r?\n")).alias("i", "line"))
    return lines.select(F.get(F.split("line", "\t"), column).alias(name), F.col("i").cast("long").alias(f"{name}_idx"))


def xenium_dims(spark: SparkSession, src: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(gene, gene_idx) and (cell, cell_idx) of the matrix, those without a count included. The first of genes of one name stands for them."""
    folder = f"{src}/cell_feature_matrix"
    if exists(spark, f"{folder}.h5"):
        genes, cells = _h5_names(f"{folder}.h5")
        of = lambda names, c: spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{c} string, {c}_idx long")
        return of(list(dict.fromkeys(genes)), "gene"), of(cells, "cell")
    if not exists(spark, f"{folder}/features.tsv.gz"):
        return None, None
    genes = _lines(spark, f"{folder}/features.tsv.gz", 1, "gene").groupBy("gene").agg(F.min("gene_idx").alias("at"))
    genes = genes.select("gene", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("gene_idx"))  # a row a gene
    return genes, _lines(spark, f"{folder}/barcodes.tsv.gz", 0, "cell")


def merscope_dims(spark: SparkSession, src: str) -> tuple[DataFrame, DataFrame]:
    """(gene, gene_idx) and (cell, cell_idx) of the dense table: its header and its first column, in order of the rows in the file."""
    df = spark.read.csv(f"{src}/cell_by_gene.csv", header=True, inferSchema=True)
    cell, *genes = df.columns
    rows = df.select(F.col(cell).cast("string").alias("cell"), F.monotonically_increasing_id().alias("k"))
    place = (F.row_number().over(Window.orderBy("k")) - 1).cast("long")  # ids alone
    return spark.createDataFrame(list(zip(genes, range(len(genes)), strict=True)), "gene string, gene_idx long"), rows.select("cell", place.alias("cell_idx"))


def _h5_names(path: str) -> tuple[list[str], list[str]]:
    import h5py

    with h5py.File(path) as f:
        g = f["matrix"] if "matrix" in f else f[next(iter(f))]
        return (g["features/name"] if "features" in g else g["gene_names"])[:].astype(str).tolist(), g["barcodes"][:].astype(str).tolist()


def tenx_h5(spark: SparkSession, path: str) -> DataFrame:
    """cell, gene, value of a 10x HDF5 matrix (needs h5py); read on the driver, as the format has no splits."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py; the matrix-market folder needs nothing") from e
    import numpy as np
    import pandas as pd

    with h5py.File(path) as f:
        g = f["matrix"] if "matrix" in f else f[next(iter(f))]
        genes = (g["features/name"] if "features" in g else g["gene_names"])[:].astype(str)
        barcodes, data, idx, ptr = g["barcodes"][:].astype(str), g["data"][:], g["indices"][:], g["indptr"][:]
    return spark.createDataFrame(pd.DataFrame({"cell": np.repeat(barcodes, np.diff(ptr)), "gene": genes[idx], "value": data.astype(float)}))


def xenium_expression(spark: SparkSession, src: str) -> DataFrame:
    if exists(spark, h5 := f"{src}/cell_feature_matrix.h5"):
        return tenx_h5(spark, h5)
    if exists(spark, f"{src}/cell_feature_matrix/matrix.mtx.gz"):
        return matrix_market(spark, f"{src}/cell_feature_matrix")
    raise FileNotFoundError(f"{src}: no cell_feature_matrix.h5 or cell_feature_matrix/")


def rings(df: DataFrame, ids=("cell_id", "EntityID", "ID")) -> DataFrame | None:
    """cell_id, ring (and rest, see wkb) from a WKB column or from vertex rows in file order (shapes of fewer than three vertices go); None if it has neither."""
    key = next((c for c in ids if c in df.columns), None)
    geometry = next((c for c in ("geometry", "Geometry", "wkb") if c in df.columns), None)
    x = next((c for c in ("vertex_x", "x", "boundaryX") if c in df.columns), None)
    y = next((c for c in ("vertex_y", "y", "boundaryY") if c in df.columns), None)
    if key is None or geometry is None and (x is None or y is None):
        return None
    if geometry:
        return df.select(F.col(key).cast("string").alias("cell_id"), decode(geometry).alias("g")).select("cell_id", "g.*").where("ring is not null")
    rows = df.select(F.col(key).cast("string").alias("cell_id"), F.struct(F.monotonically_increasing_id().alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("p"))
    ring = rows.groupBy("cell_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).where("size(ps) >= 3")  # a shape's own vertices
    ring = ring.select("cell_id", F.transform("ps", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return ring.select("cell_id", F.when(F.get("ring", 0) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.array(F.get("ring", 0)))).alias("ring"))


def xenium_boundaries(spark: SparkSession, src: str, nucleus: bool = False) -> DataFrame | None:
    order = ["nucleus", "cell"] if nucleus else ["cell", "nucleus"]
    for which in order:
        if exists(spark, path := f"{src}/{which}_boundaries.parquet"):
            return rings(spark.read.parquet(path))
    return None


def xenium_images(spark: SparkSession, src: str) -> dict:
    """{default, pixel_size, version, images: {name: file}} from the focus images, the z-stack and the projection that are there."""
    specs = json.loads(text_of(spark, f"{src}/experiment.xenium") or "{}")
    focus = [n for n in names(spark, f"{src}/morphology_focus") if n.endswith(".tif")]
    images = {n.removesuffix(".tif").removesuffix(".ome"): f"morphology_focus/{n}" for n in focus}
    for name in ("morphology", "morphology_mip"):
        if exists(spark, f"{src}/{name}.ome.tif"):
            images[name] = f"{name}.ome.tif"
    default = next(iter(images)) if focus else "morphology" if "morphology" in images else None
    return {"default": default, "pixel_size": specs.get("pixel_size", PIXEL_SIZE), "version": specs.get("analysis_sw_version", "").removeprefix("xenium-"), "images": images}


def merscope_cells(spark: SparkSession, src: str) -> DataFrame:
    return canonical(spark.read.csv(f"{src}/cell_metadata.csv", header=True, inferSchema=True), MERSCOPE)


def merscope_expression(spark: SparkSession, src: str) -> DataFrame:
    """cell, gene, value of the dense table, zeros dropped; its first column is the cell."""
    df = spark.read.csv(f"{src}/cell_by_gene.csv", header=True, inferSchema=True)
    cell, *genes = df.columns
    long = df.select(F.col(cell).cast("string").alias("cell"), *[F.col(f"`{g}`").cast("double").alias(g) for g in genes]).unpivot("cell", [F.col(f"`{g}`") for g in genes], "gene", "value")
    return long.where("value <> 0")


def merscope_boundaries(spark: SparkSession, src: str) -> DataFrame | None:
    folder = f"{src}/cell_boundaries"
    if not any(n.endswith(".parquet") for n in names(spark, folder)):
        return None
    return rings(spark.read.option("mergeSchema", "true").parquet(folder), ("EntityID", "cell_id", "ID"))


def merscope_image(spark: SparkSession, src: str) -> dict:
    tifs = [n for n in names(spark, f"{src}/images") if n.endswith(".tif")]
    best = "mosaic_DAPI_z0.tif" if "mosaic_DAPI_z0.tif" in tifs else next(iter(tifs), None)
    return {"default": best.removesuffix(".tif") if best else None, "pixel_size": 1.0, "images": {n.removesuffix(".tif"): f"images/{n}" for n in tifs}}


def link_or_copy(spark: SparkSession, src: str, dst: str, copy: bool = False) -> None:
    """A symbolic link for local files, or a copy where that fails, is asked for, or either lies in another store."""
    fs, to = _fs(spark, dst)
    own, at = _fs(spark, src)
    if not own.exists(at):
        raise FileNotFoundError(src)
    fs.mkdirs(to.getParent())
    if not copy and {own.getScheme(), fs.getScheme()} == {"file"}:
        try:
            os.symlink(os.path.abspath(at.toUri().getPath()), to.toUri().getPath())
            return
        except OSError:
            pass
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(own, at, fs, to, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"could not copy {src}")
