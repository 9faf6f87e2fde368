"""Affinities of node pairs that learn from cycle to cycle, with their state in versioned tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import saved, scratch
from .supervision import KNOBS, plasticity, recovered, trimmed

#: Nodes of the largest impact whose pairs are all candidates, and pairs suggested in a step.
ANCHORS, SUGGESTED = 28, 3


@dataclass
class Memory:
    """pairs: u, v, affinity, eligibility, on, off; nodes: node, budget; signals: node, before."""

    pairs: DataFrame
    nodes: DataFrame
    signals: DataFrame


def fresh(spark: SparkSession, node: str = "string") -> Memory:
    empty = lambda schema: spark.createDataFrame([], schema)
    return Memory(empty(f"u {node}, v {node}, affinity double, eligibility double, on int, off int"), empty(f"node {node}, budget double"), empty(f"node {node}, before double"))


def candidates(nodes: DataFrame, edges: DataFrame, impact: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(u, v, edge): all pairs of the nodes of the largest impact (of any nodes, if there is no impact; ties by node), and
    the pairs of all edges, each once.  The pairs of anchors are few, those of edges are as many as the edges."""
    ranked = nodes.select("node", F.lit(0.0).alias("impact")) if impact.isEmpty() else impact.select("node", "impact")
    top = saved(ranked.orderBy(F.desc(F.abs("impact")), "node").limit(anchors).select("node", F.lit(1).alias("all")))
    both = top.select(F.col("node").alias("u"), "all").join(top.select(F.col("node").alias("v"), "all"), "all").where("u < v").select("u", "v", F.lit(False).alias("edge"))
    held = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.lit(True).alias("edge"))
    return both.unionByName(held).groupBy("u", "v").agg(F.max("edge").alias("edge"))


def step(memory: Memory, nodes: DataFrame, edges: DataFrame, impact: DataFrame, risk: float = 0.0, knobs: dict[str, float] = KNOBS, anchors: int = ANCHORS, most: int = 24_000) -> tuple[Memory, list[tuple], list[tuple]]:
    """(memory, pairs to join, pairs to part) after a step.

    Budgets of all nodes recover first.  Candidate pairs are updated from the impact now and that of the step before; all
    others keep their state.  Pairs without an edge that stood above the upper threshold for `dwell` steps are to be
    joined, the strongest first; pairs with one that stood below the lower, the weakest first; at most three each, ties by
    their names.  A graph of fewer than two nodes only remembers its impact."""
    with scratch(nodes.sparkSession) as keep:
        budgets = nodes.select("node").distinct().join(memory.nodes, "node", "full_outer").select("node", F.coalesce("budget", F.lit(1.0)).alias("budget"))
        known = nodes.select("node").distinct().withColumn("in", F.lit(True))
        budgets = recovered(budgets.join(known, "node", "left").where("in")).drop("in").unionByName(budgets.join(known, "node", "left_anti"))
        budgets = saved(budgets)
        signals = keep(saved(impact.select("node", F.col("impact").cast("double").alias("before"))))
        if nodes.select("node").distinct().limit(2).count() < 2:
            return Memory(memory.pairs, keep(budgets), signals), [], []
        asked = saved(candidates(nodes, edges, impact, anchors))
        now = impact.select("node", F.col("impact").cast("double").alias("now")).join(memory.signals, "node", "full_outer").fillna(0.0, ["now", "before"])
        state = asked.join(memory.pairs, ["u", "v"], "left").fillna(0.0, ["affinity", "eligibility"]).fillna(0, ["on", "off"])
        after, left = plasticity(state.drop("edge"), now, budgets, risk, knobs)
        after = saved(after)
        rest = memory.pairs.join(asked, ["u", "v"], "left_anti")
        pairs = after.unionByName(rest.select(*after.columns))
        pairs = keep(saved(pairs if pairs.count() <= most else trimmed(pairs, most)))
        marked = after.join(asked, ["u", "v"])
        first = lambda where, order: [tuple(r) for r in marked.where(where).orderBy(*order, "u", "v").limit(SUGGESTED).select("u", "v").collect()]
        dwell = int(knobs["dwell"])
        joined, parted = first(~F.col("edge") & (F.col("on") >= dwell), [F.desc("affinity")]), first(F.col("edge") & (F.col("off") >= dwell), ["affinity"])
        return Memory(pairs, keep(saved(left)), signals), joined, parted


def store(memory: Memory, folder: str, version: int) -> None:
    """The memory as a version of its own; one that exists is not written again."""
    for name in ("pairs", "nodes", "signals"):
        getattr(memory, name).write.mode("errorifexists").parquet(f"{folder}/version={version}/{name}")


def load(spark: SparkSession, folder: str, version: int | None = None) -> Memory:
    """The memory of a version, or of the last one that was written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = lambda v: all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={v}/{n}/_SUCCESS")) for n in ("pairs", "nodes", "signals"))
    versions = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.getPath().getName().startswith("version=")] if version is None else [version]
    versions = [v for v in versions if whole(v)]
    if not versions:
        raise FileNotFoundError(f"{folder} holds no whole version")
    return Memory(*(spark.read.parquet(f"{folder}/version={max(versions)}/{n}") for n in ("pairs", "nodes", "signals")))
