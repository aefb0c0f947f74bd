"""What the operators share: table access, the shared folder, written intermediate tables."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own serves a local master; on a cluster it
    would be lost with its machine, so it is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="histomesh-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that written() made and discard() didn't take away yet.
_LIVE: dict[str, None] = {}


def live() -> list[str]:
    return list(_LIVE)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors. discard() takes it away."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    _LIVE[path] = None
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        sweep(df.sparkSession, [df.written_path])


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Removes the written tables at these paths."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _LIVE.pop(name, None)


def bound_arrow(spark: SparkSession, nbytes: int = 8 << 20) -> None:
    """Bound Arrow batches by bytes, so that long texts don't fill a Python worker. A setting of the session, as results are evaluated later; it replaces
    Spark's own defaults only, a value set by the user stays."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(nbytes)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")):
        if spark.conf.get(key, None) in (None, "2147483647", "9223372036854775807", "268435456", "10000"):
            spark.conf.set(key, value)


_HELD: dict = {}


def sent(spark: SparkSession, value) -> tuple:
    """(key, broadcast) of the pickled value, for held()."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(value, protocol=5))


def held(key: str, broadcast):
    """The value of a broadcast, unpickled once a Python worker, however many tasks it runs; one value at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = pickle.loads(broadcast.value)
    return _HELD[key]


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A row number that is the same each time the same files are scanned, as in a retried task."""
    return df.withColumn(name, F.monotonically_increasing_id())


def ordered(df: DataFrame, name: str, id_col: str, text_col: str) -> DataFrame:
    """df with a row number in order of id (nulls last) and the text's hash, written together: every later scan reads the same number for a row,
    whatever executors there are by then, and rows compare alike whatever files they came in. Rows equal in both are dealt out by a third key."""
    h, salt = free_name(df, "row_hash"), free_name(df, "row_salt")
    key = [F.col(id_col).asc_nulls_last(), F.col(h), F.col(salt)]
    rows = with_row_id(df.withColumn(h, F.xxhash64(F.col(text_col))), salt)
    return written(with_row_id(rows.repartitionByRange(*key).sortWithinPartitions(*key).drop(h, salt), name), "numbered")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front if df has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
