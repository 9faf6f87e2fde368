"""Predictors of what a shock reaches, for many scenarios (scenario, target) in one job.

edges: (ord, src, dst, layer, weight).  All give (scenario, rank, node), at most k nodes a scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .propagation import FLOOR, HOPS


def _first(rows: DataFrame, order: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("scenario", "rank", "node")


def plain(scenarios: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The target and its neighbours in the order of the edges, a neighbour of several edges several times."""
    ends = edges.select("ord", F.explode(F.array(F.struct(F.col("src").alias("target"), F.col("dst").alias("node")), F.struct(F.when(F.col("src") != F.col("dst"), F.col("dst")).alias("target"), F.col("src").alias("node")))).alias("e"))
    near = scenarios.join(ends.select("ord", "e.target", "e.node"), "target").select("scenario", F.lit(1).alias("late"), "ord", "node")
    own = scenarios.select("scenario", F.lit(0).alias("late"), F.lit(None).cast(edges.schema["ord"].dataType).alias("ord"), F.col("target").alias("node"))
    return _first(own.unionByName(near), ["late", "ord"], k)


def lexical(scenarios: DataFrame, edges: DataFrame, k: int = 3, words: str = "predict spread from") -> DataFrame:
    """The ends of the edges whose words contain most terms of a question about the target, each end once, in the order of
    the edges.  Terms of the question that are the same for all scenarios are counted once an edge."""
    terms = list(dict.fromkeys(words.lower().split()))
    text = F.lower(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), "layer", F.lit("{}")))
    common = sum((text.contains(t).cast("int") for t in terms), F.lit(0))
    own = F.array_except(F.array_distinct(F.split(F.lower(F.trim(F.col("target").cast("string"))), r"\s+")), F.array(*map(F.lit, [*terms, ""])))
    asked = scenarios.select("scenario", own.alias("own"))
    limit = max(2 * k, 4)
    rows = edges.select("ord", "src", "dst", text.alias("text"), common.alias("common")).crossJoin(F.broadcast(asked))  # a stated set of questions
    score = F.col("common") + F.aggregate("own", F.lit(0), lambda s, t: s + F.contains(F.col("text"), t).cast("int"))
    found = rows.withColumn("score", score).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("score"), "ord"))
    best = found.withColumn("at", rank).where(F.col("at") <= limit)
    ends = best.select("scenario", "at", F.posexplode(F.array("src", "dst")).alias("side", "node"))
    once = ends.groupBy("scenario", "node").agg(F.min(F.struct("at", "side")).alias("at"))
    return _first(once, ["at"], k)


def flow(scenarios: DataFrame, adjacency: DataFrame, k: int = 3, strength: float = 1.0, keep: float = 0.6, hops: int = HOPS) -> DataFrame:
    """The nodes of the largest impact after a spread from the target, to nine decimals; adjacency: (node, nbr, polarity)."""
    state = scenarios.select("scenario", F.col("target").alias("node"), F.lit(float(strength)).alias("impact"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        if strength <= FLOOR:
            break
        strength *= keep
        acting = state.where(F.col("hop") == hop - 1).select("scenario", "node", F.when(F.col("impact") >= 0, 1).otherwise(-1).alias("sign"))
        given = acting.join(adjacency.select("node", "nbr", "polarity").distinct(), "node").groupBy("scenario", F.col("nbr").alias("node")).agg(F.sum(F.col("sign") * F.col("polarity") * strength).alias("given"))
        state = state.join(given, ["scenario", "node"], "full_outer").select("scenario", "node", (F.coalesce("impact", F.lit(0.0)) + F.coalesce("given", F.lit(0.0))).alias("impact"), F.coalesce("hop", F.lit(hop)).alias("hop"))
    return _first(state, [F.desc(F.round("impact", 9)), "node"], k)


def truth(scenarios: DataFrame, adjacency: DataFrame, k: int = 3, keep: float = 0.6, hops: int = HOPS) -> DataFrame:
    """What a shock is held to reach: the nodes of the largest summed strength, where each node passes on the largest that
    reached it in the hop before."""
    front = scenarios.select("scenario", F.col("target").alias("node"), F.lit(1.0).alias("s"))
    total = front
    for _ in range(hops):
        sent = front.where(F.col("s") * keep > FLOOR).join(adjacency.select("node", "nbr").distinct(), "node").select("scenario", F.col("nbr").alias("node"), (F.col("s") * keep).alias("s"))
        total = total.unionByName(sent)
        front = sent.groupBy("scenario", "node").agg(F.max("s").alias("s"))
    return _first(total.groupBy("scenario", "node").agg(F.sum("s").alias("score")), [F.desc(F.round("score", 9)), "node"], k)
