"""Tables that iterations leave in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where all work is in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="tidemesh-"))
    return sc.getCheckpointDir()


class _Blocks(threading.local):
    def __init__(self):
        self.open: list[set[str]] = []


_blocks = _Blocks()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that `saved` writes in this block are deleted at its end, but for those given to the function it yields."""
    mine: set[str] = set()
    kept: list[DataFrame] = []
    _blocks.open.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _blocks.open.pop()
        held = {df._path for df in kept}
        for path in mine - held:
            spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")  # only dealt tables have a name
            _delete(spark, path)
        if _blocks.open:
            _blocks.open[-1].update(mine & held)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Like `saved`, for rows that meet others by one key again and again: in buckets of the key, so that later joins and
    sums by it deal out only what they bring.  Outside of `scratch` the table keeps its name until the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    if _blocks.open:
        _blocks.open[-1].add(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(_name(path))
    out = spark.table(_name(path))
    out._path = path
    return out


def saved(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet and read back: lineage ends there, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    if _blocks.open:
        _blocks.open[-1].add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out
