"""Adapters: named mappings from records to a checked graph, and as sources that `spark.read.format` knows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import validation
from . import graphs
from .tables import saved


@dataclass(frozen=True)
class Mapping:
    """Which fields are nodes, of what kind, and which pairs of fields are edges (source field, target field, layer,
    weight); `order` are the fields that order the records, no two alike."""

    node_fields: tuple[tuple[str, str], ...]
    edge_rules: tuple[tuple[str, str, str, float], ...]
    ts: str
    target: str
    order: tuple[str, ...]
    intensity: float = 1.0


@dataclass
class Build:
    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    perturbation: DataFrame
    report: DataFrame


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with the place of each row, from 0, in an order in which no two rows are alike.  Rows lie in ranges, each
    numbered by itself, after the count of rows in the ranges before it."""
    rows = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    # one row a range: no more than Spark has shuffle partitions
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn(name, place).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def perturbation(records: DataFrame, m: Mapping) -> DataFrame:
    """One row (target, n, ts, intensity): the most frequent target, ties to the first seen, records without a time counted
    too, at the latest time; no target and the present time for no records."""
    best = graphs.default_perturbation(records, m.target, m.ts, list(m.order), m.intensity).select("target", "n")
    latest = records.agg(F.coalesce(F.max(m.ts).cast("timestamp"), F.current_timestamp()).alias("ts"))
    return latest.join(F.broadcast(best), F.lit(True), "left").select("target", "n", "ts", F.lit(max(0.0, float(m.intensity))).alias("intensity"))


def build(records: DataFrame, m: Mapping, graph_id: str = "graph", schema_version: str = "1") -> Build:
    """The graph of the records, what is wrong with it, a perturbation and a report.  A graph with issues is returned all
    the same.  Edges are numbered in the order of records and rules: `{graph_id}:e:{number}`."""
    nodes, edges = graphs.mapped(records, dict(m.node_fields), list(m.edge_rules), m.ts, list(m.order))
    edges = numbered(edges.select(F.struct("at", "rule").alias("ord"), "ts", "src", "dst", "layer", F.col("weight").cast("double").alias("weight")), ["ord"], "idx")
    edges = saved(edges.select(F.concat(F.lit(f"{graph_id}:e:"), "idx").alias("edge_id"), "ord", "ts", "src", "dst", "layer", "weight", F.create_map(F.lit("source_record_idx"), F.col("idx").cast("string")).alias("metadata")))
    found = saved(validation.issues(edges, nodes, graph_id=graph_id, schema_version=schema_version))
    return Build(nodes, edges, found, perturbation(records, m), validation.report(records, dict(m.node_fields), list(m.edge_rules), found))


_known: dict[str, Callable[..., Mapping]] = {}


def _key(name: str) -> str:
    return name.strip().lower()


def register(name: str, mapping: Callable[..., Mapping], spark: SparkSession | None = None) -> None:
    """Makes a mapping known under a name (white space at its ends and case do not count); with a session, also as the
    format of a source: `spark.read.format(name).load(folder)` reads the edges of Parquet records."""
    if not _key(name):
        raise ValueError("an adapter needs a name")
    _known[_key(name)] = mapping
    if spark is not None:
        spark.dataSource.register(source(_key(name), mapping()))


def get(name: str) -> Callable[..., Mapping]:
    if _key(name) not in _known:
        raise KeyError(f"no adapter is called {name!r}")
    return _known[_key(name)]


def names() -> list[str]:
    return sorted(_known)


def generic(source: str = "source", target: str = "target", ts: str = "ts") -> Mapping:
    """Records that are edges themselves."""
    return Mapping(((source, "entity"), (target, "entity")), ((source, target, "default", 1.0),), ts, source, (ts, source, target))


register("generic", generic)

_EDGES = "file string, record long, rule int, ts timestamp, src string, dst string, layer string, weight double"


@dataclass
class _Group(InputPartition):
    path: str
    group: int
    first: int


def source(name: str, m: Mapping) -> type[DataSource]:
    """A source of edges (file, record, rule, ts, src, dst, layer, weight).  A task reads one row group of one file, only
    the columns of the mapping; the folder is any that Arrow's file systems open (local, HDFS, object stores).  Edges keep
    the place of their record in its file, so they can be put in order and numbered."""

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self) -> list[InputPartition]:
            import pyarrow.fs as fs
            import pyarrow.parquet as pq

            system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
            info = system.get_file_info(base)
            files = [base] if info.is_file else sorted(f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.path.endswith(".parquet"))
            out: list[InputPartition] = []
            for path in files:
                with system.open_input_file(path) as f:
                    meta, first = pq.ParquetFile(f).metadata, 0
                    for g in range(meta.num_row_groups):
                        out.append(_Group(path, g, first))
                        first += meta.row_group(g).num_rows
            return out or [_Group("", -1, 0)]

        def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute as pc
            import pyarrow.fs as fs
            import pyarrow.parquet as pq

            if part.group < 0:
                return
            system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
            columns = sorted({m.ts, *(f for rule in m.edge_rules for f in rule[:2])})
            with system.open_input_file(part.path) as f:
                at = part.first
                for batch in pq.ParquetFile(f).iter_batches(row_groups=[part.group], columns=columns):
                    places = pa.array(range(at, at + batch.num_rows), pa.int64())
                    at += batch.num_rows
                    field = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
                    for k, (a, b, layer, weight) in enumerate(m.edge_rules):
                        kept = pc.and_(pc.and_(pc.is_valid(field[a]), pc.is_valid(field[b])), pc.is_valid(field[m.ts]))
                        n = pc.sum(kept).as_py() or 0
                        if n:
                            pick = lambda x, t, kept=kept: x.filter(kept).cast(t)
                            same = lambda x, t, n=n: pa.array([x] * n, t)
                            yield pa.RecordBatch.from_arrays(
                                [same(part.path, pa.string()), pick(places, pa.int64()), same(k, pa.int32()), pick(field[m.ts], pa.timestamp("us", "UTC")), pick(field[a], pa.string()), pick(field[b], pa.string()), same(layer, pa.string()), same(max(0.0, float(weight)), pa.float64())],
                                ["file", "record", "rule", "ts", "src", "dst", "layer", "weight"],
                            )

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return _EDGES

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"])

    return Source
