"""What the operators share: narrow inputs, written tables between stages, connected components."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, never meet an operator's own columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def unused(columns: list[str], name: str) -> str:
    """The name, with as many underscores as it takes to be none of the columns (case does not tell names apart)."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).  Only where all work is in one process, as in tests, may it
    be unset: then it is a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and re.match(r"local(\[|$)", sc.master):
            place = tempfile.mkdtemp(prefix="tidemesh-")
        if not place:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


class _Tables:
    """Tables written within a `scratch` block."""

    def __init__(self):
        self.paths: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """The table outlives this block: it belongs to the block around it, if there is one."""
        mine = {p: s for p, s in self.paths.items() if any(p.rsplit("/", 1)[1] in f for f in df.inputFiles())}
        for p, s in mine.items():
            del self.paths[p]
            if len(_open.blocks) > 1:
                _open.blocks[-2].paths[p] = s
        return df


class _Open(threading.local):
    def __init__(self):
        self.blocks: list[_Tables] = []


_open = _Open()


@contextmanager
def scratch():
    """Tables that `saved` writes in this block are deleted at its end, but for those that are kept."""
    _open.blocks.append(_Tables())
    try:
        yield _open.blocks[-1]
    finally:
        for path, spark in _open.blocks.pop().paths.items():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: lineage ends there, so a lost
    executor costs the readers nothing, and several readers share one computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if _open.blocks:
        _open.blocks[-1].paths[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _forest(batches):
    """Replaces the links of one partition by a star to the smallest node of each locally connected group."""
    pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not pairs:
        return
    edges = np.concatenate(pairs, axis=1)
    nodes, ends = np.unique(edges, return_inverse=True)
    labels = local_labels(len(nodes), *ends.reshape(2, -1))
    keep = np.flatnonzero(labels != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[labels[keep]])], ["a", "b"])


def local_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes: hooking and pointer jumping on arrays."""
    labels = np.arange(n)
    while len(left):
        a, b = labels[left], labels[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
    return labels


def _stars(links: DataFrame) -> bool:
    """Whether every a has one b only and no b is an a: one aggregation with map-side combine."""
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b")))
    seen = ends.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n"), F.count("b").alias("own"))
    return seen.where("low <> high or (own > 0 and n > own)").agg(F.count("*")).first()[0] == 0


#: A task that reduces links to stars gets about so many.
_LINKS_A_TASK = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable through `edges` (a, b), for every node that has a link.

    Large-star and small-star rounds alternate until all links are stars.  Before the first round and at the end of
    each, every task replaces its own links by stars, which shortens paths without a shuffle.  Links are written to
    the shared folder after each round; nothing is gathered on the driver but counts.
    """
    star = "a long, b long"
    links = saved(edges.where("a <> b").mapInArrow(_forest, star).distinct())
    while not _stars(links):
        tasks = 8 + links.count() // _LINKS_A_TASK
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("x"), F.col("m").alias("y"))
        small = small.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        links = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        links = saved(links.coalesce(tasks).mapInArrow(_forest, star))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots).distinct()
