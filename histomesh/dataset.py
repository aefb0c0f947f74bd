"""A dataset directory: cells, expression with its dimensions, boundaries, images, results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.config import DatasetConfig
from histomesh.operators.cells import feature_values, tiles, validate, within_bbox
from histomesh.operators.shapes import query_bbox, with_bbox
from histomesh.sources import vendors
from histomesh.sources.catalog import ResultCatalog, checkpointed, replace_table
from histomesh.sources.images import ImageCollection


@dataclass(frozen=True)
class TileView:
    """A tile of a dataset: its own bounds, and the dataset's tables cut to them with the overlap on each side."""

    data: Dataset
    tile_id: int
    x_min: float
    y_min: float
    x_max: float
    y_max: float

    @property
    def _box(self) -> tuple[float, float, float, float]:
        by = self.data.config.tile_overlap
        return self.x_min - by, self.y_min - by, self.x_max + by, self.y_max + by

    @property
    def cells(self) -> DataFrame:
        return within_bbox(self.data.cells, *self._box)

    @property
    def boundaries(self) -> DataFrame | None:
        return query_bbox(self.data.boundaries, *self._box) if self.data.has_boundaries else None

    @property
    def images(self) -> ImageCollection | None:
        return self.data.image_collection if self.data.has_images else None


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df with the rows' places, from 0, without gaps: in order of partitions, whose sizes alone reach the driver."""
    rows = checkpointed(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(map(tuple, rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()))  # a row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return rows.join(F.broadcast(starts), part == F.col("_p")).withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_start")


class Dataset:
    """Tables under config.root. Opening needs cells and expression; boundaries and images may be absent."""

    def __init__(self, spark: SparkSession, config: DatasetConfig):
        self.spark, self.config = spark, config
        for name in ("cells", "expression"):
            if not vendors.exists(spark, self._path(name)):
                raise FileNotFoundError(self._path(name))
        self.results = ResultCatalog(spark, config.root)

    def _path(self, name: str) -> str:
        return f"{self.config.root.rstrip('/')}/{name}.parquet"

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(self._path("cells"))

    @property
    def expression(self) -> DataFrame:
        return self.spark.read.parquet(self._path("expression"))

    def _dimension(self, name: str, column: str) -> DataFrame:
        if vendors.exists(self.spark, self._path(name)):
            return self.spark.read.parquet(self._path(name))
        return _numbered(self.expression.select(column).distinct().orderBy(column), f"{column}_idx")

    @property
    def genes(self) -> DataFrame:
        """gene, gene_idx of every gene, those without a count included."""
        return self._dimension("genes", "gene")

    @property
    def expression_cells(self) -> DataFrame:
        """cell, cell_idx of every column of the matrix, those without a count included."""
        return self._dimension("expression_cells", "cell")

    @property
    def has_boundaries(self) -> bool:
        return vendors.exists(self.spark, self._path("boundaries"))

    @property
    def boundaries(self) -> DataFrame:
        return self.spark.read.parquet(self._path("boundaries"))

    @property
    def images(self) -> dict:
        return json.loads(vendors.text_of(self.spark, f"{self.config.root}/images_meta.json") or '{"images": {}}')

    @property
    def image_collection(self) -> ImageCollection:
        return ImageCollection(self.spark, self.config.root, self.images)

    @property
    def has_images(self) -> bool:
        return bool(self.image_collection.keys())

    @property
    def has_morphology(self) -> bool:
        """Whether there is a default image."""
        return self.image_collection.default_image is not None

    def n_cells(self) -> int:
        return self.cells.count()

    def n_genes(self) -> int:
        return self.genes.count()

    def obs_columns(self) -> list[str]:
        return self.cells.columns

    def register(self) -> None:
        """Temporary views cells, expression, boundaries, for spark.sql."""
        for name in ("cells", "expression", *["boundaries"] * self.has_boundaries):
            getattr(self, name).createOrReplaceTempView(name)

    def iter_tiles(self) -> Iterator[TileView]:
        """The tiles of the config's size over the cells' box, in order; rows of the grid are brought over as they are used."""
        for t in tiles(self.cells, self.config.tile_size, self.config.tile_overlap).orderBy("tile").toLocalIterator():
            yield TileView(self, t.tile, t.x_min, t.y_min, t.x_max, t.y_max)

    def feature(self, name: str) -> DataFrame:
        """cell_id, value, categorical of every cell: of a result's first column beside the id, else of a gene's counts (0 where there are none),
        else of a column of cells; ValueError if there is none of that name."""
        if self.results.has(name):
            table = self.results.get(name)
            if others := [c for c in table.columns if c != "cell_id"]:
                return feature_values(self.cells, table, others[0])
        if not self.genes.where(F.col("gene") == name).isEmpty():
            counts = self.expression.where(F.col("gene") == name).select(F.col("cell").cast("string").alias("cell_id"), F.col("value").cast("double").alias("value"))
            return feature_values(self.cells, counts, "value").withColumn("value", F.coalesce("value", F.lit(0.0)))
        if name in self.cells.columns:
            return feature_values(self.cells, self.cells, name)
        raise ValueError(f"{name} is no result, gene or column of cells")

    def save_cells(self, cells: DataFrame) -> None:
        """Replaces cells; they may derive from the present ones, which stay in place until the new ones are written."""
        replace_table(validate(cells), self._path("cells"), self.config.codec)

    def _rename(self, name: str, column: str, names: list[str]) -> None:
        have = self._dimension(name, column)
        if (n := have.count()) != len(names):
            raise ValueError(f"{len(names)} names for {n} of {column}")
        if len(set(names)) != len(names):
            raise ValueError(f"names of {column} are not unique")
        kind = have.schema[column].dataType.simpleString()
        new = self.spark.createDataFrame(list(enumerate(names)), f"{column}_idx long, new {kind}")
        both = checkpointed(have.join(new, f"{column}_idx"))
        other = [c for c in self.expression.columns if c != column]
        fresh = self.expression.join(both.select(column, "new"), column).select(*other, F.col("new").alias(column)).select(*self.expression.columns)
        replace_table(fresh, self._path("expression"), self.config.codec)
        replace_table(both.select(F.col("new").alias(column), f"{column}_idx"), self._path(name), self.config.codec)

    def set_gene_names(self, names: list[str]) -> None:
        """Renames the genes, in order of gene_idx."""
        self._rename("genes", "gene", names)

    def set_cell_names(self, names: list) -> None:
        """Renames the matrix's cells, in order of cell_idx."""
        self._rename("expression_cells", "cell", names)

    def write_chunk(self, start: int, chunk: DataFrame) -> None:
        """Replaces the counts of a run of the matrix's cells. chunk: row (from 0; the cell's place less start), gene, value. Unknown genes and places
        outside the matrix raise; zeros are not stored."""
        places = self.expression_cells.select("cell", F.col("cell_idx").alias("idx"))
        n = chunk.agg(F.min("row"), F.max("row")).first()
        if n[0] is not None and (start + n[0] < 0 or start + n[1] >= places.count()):
            raise ValueError("the chunk leaves the matrix")
        if not chunk.join(self.genes, "gene", "left_anti").isEmpty():
            raise ValueError("the chunk has unknown genes")
        at = checkpointed(chunk.withColumn("idx", F.col("row") + start).join(places, "idx").select("cell", "gene", F.col("value").cast("double").alias("value")))
        rest = self.expression.join(at.select("cell").distinct(), "cell", "left_anti")
        replace_table(rest.unionByName(at.where("value <> 0").select(*rest.columns)), self._path("expression"), self.config.codec)

    @staticmethod
    def create(
        spark: SparkSession, config: DatasetConfig, cells: DataFrame, expression: DataFrame, boundaries: DataFrame | None = None, images: dict | None = None,
        genes: DataFrame | None = None, expression_cells: DataFrame | None = None,
    ) -> Dataset:
        """Writes a new dataset; root must not exist. cells get cell_idx, their order in the input, so that batches don't lean on row order. genes (gene,
        gene_idx) and expression_cells (cell, cell_idx): the matrix's dimensions; without them, what has counts."""
        if vendors.exists(spark, config.root):
            raise FileExistsError(config.root)
        root = config.root.rstrip("/")
        codec = {"compression": config.codec, "maxRecordsPerFile": config.rows_per_file}
        if boundaries is not None:
            if missing := [c for c in ("cell_id", "ring") if c not in boundaries.columns]:
                raise ValueError(f"boundaries have no {missing}")
        (cells if "cell_idx" in cells.columns else _numbered(validate(cells), "cell_idx")).write.options(**codec).parquet(f"{root}/cells.parquet")
        expression.write.options(**codec).parquet(f"{root}/expression.parquet")
        for name, table in (("genes", genes), ("expression_cells", expression_cells)):
            if table is not None:
                table.write.options(**codec).parquet(f"{root}/{name}.parquet")
        if boundaries is not None:
            with_bbox(boundaries).write.options(**codec).parquet(f"{root}/boundaries.parquet")
        if images and images.get("images"):
            spark.createDataFrame([(json.dumps(images),)], "value string").coalesce(1).write.text(f"{root}/images_meta.json")
        return Dataset(spark, config)


def _with_images(spark: SparkSession, src: str, data: Dataset, copy: bool) -> Dataset:
    """Links or copies the image files of the registry into the dataset's images folder, under their names."""
    for file in data.images["images"].values():
        vendors.link_or_copy(spark, f"{src}/{file}", f"{data.config.root.rstrip('/')}/images/{file.rsplit('/', 1)[-1]}", copy)
    return data


def from_xenium(spark: SparkSession, src: str, config: DatasetConfig, use_nucleus_boundaries: bool = False, copy_images: bool = False) -> Dataset:
    genes, cells = vendors.xenium_dims(spark, src)
    data = Dataset.create(spark, config, vendors.xenium_cells(spark, src), vendors.xenium_expression(spark, src), vendors.xenium_boundaries(spark, src, use_nucleus_boundaries), vendors.xenium_images(spark, src), genes, cells)
    return _with_images(spark, src, data, copy_images)


def from_merscope(spark: SparkSession, src: str, config: DatasetConfig, copy_images: bool = False) -> Dataset:
    genes, cells = vendors.merscope_dims(spark, src)
    data = Dataset.create(spark, config, vendors.merscope_cells(spark, src), vendors.merscope_expression(spark, src), vendors.merscope_boundaries(spark, src), vendors.merscope_image(spark, src), genes, cells)
    return _with_images(spark, src, data, copy_images)
