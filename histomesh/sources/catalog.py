"""Results by key: Parquet tables under a folder, written aside and then renamed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read from there. Where none is set, a folder of our own serves a local master; on a cluster
    that would be lost with its machine, so it is an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="histomesh-"))
    return df.checkpoint()


def replace_table(df: DataFrame, path: str, codec: str | None = None) -> None:
    """Writes df aside, then puts it in the place of the table at path, which df may derive from; on failure that table is back in place."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    to = at(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    parent, name = path.rsplit("/", 1)
    aside, old = (at(f"{parent}/.{name}-{kind}{uuid.uuid4().hex}") for kind in ("", "old-"))
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(aside.toString())
    there = fs.exists(to)
    if there and not fs.rename(to, old):
        fs.delete(aside, True)
        raise OSError(f"could not move {path} away")
    if not fs.rename(aside, to):
        if there:
            fs.rename(old, to)
        fs.delete(aside, True)
        raise OSError(f"could not put {path} in place")
    if there:
        fs.delete(old, True)


class ResultCatalog:
    """Tables by key under root/maps; keys of hidden entries (leading dot or underscore) don't show."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, key: str) -> str:
        return f"{self.root}/maps/{key}"

    def has(self, key: str) -> bool:
        return self._fs.exists(self._path(self.path(key)))

    def keys(self) -> list[str]:
        top = self._path(f"{self.root}/maps")
        if not self._fs.exists(top):
            return []
        return sorted(n for f in self._fs.listStatus(top) if not (n := f.getPath().getName()).startswith((".", "_")))

    def get(self, key: str) -> DataFrame:
        if not self.has(key):
            raise KeyError(key)
        return self.spark.read.parquet(self.path(key))

    def graph(self, key: str) -> DataFrame:
        """An edge table (cell_id_a, cell_id_b, ...) by key; FileNotFoundError if it wasn't built yet."""
        if not self.has(key):
            raise FileNotFoundError(f"graph {key} not found: build it and put it under this key first")
        edges = self.get(key)
        if missing := {"cell_id_a", "cell_id_b"} - set(edges.columns):
            raise ValueError(f"{key} is no graph: it has no {sorted(missing)}")
        return edges

    def put(self, key: str, df: DataFrame, force: bool = True) -> str:
        """Writes df under key and returns key. Without force, an existing table stays."""
        if force or not self.has(key):
            replace_table(df, self.path(key))
        return key

    def fitted(self, key: str, make, **parameters) -> DataFrame:
        """The table under key, if it was made with these parameters; else make() is put there, and the parameters beside it."""
        spark, beside = self.spark, f"_{key}_parameters"
        stamp = {k: repr(v) for k, v in parameters.items()}
        if self.has(key) and self.has(beside) and {r.name: r.value for r in self.get(beside).collect()} == stamp:
            return self.get(key)
        if self.has(beside):
            self.delete(beside)
        self.put(key, make())
        self.put(beside, spark.createDataFrame(sorted(stamp.items()), "name string, value string"))
        return self.get(key)

    def delete(self, key: str) -> None:
        if not self.has(key):
            raise KeyError(key)
        self._fs.delete(self._path(self.path(key)), True)
