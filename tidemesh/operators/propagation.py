"""Spread of a shock over a graph, hop by hop, as joins of a frontier with the adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved
from .ordered import carried, number, own

# Hops, halving per hop, smallest strength, smallest impact of a suggested link, number of those.
HOPS, KEEP, FLOOR, LINK, LINKS = 3, 0.5, 0.01, 0.25, 3


def spread(seeds: DataFrame, adjacency: DataFrame, strength: float = 1.0, keep: float = KEEP, hops: int = HOPS) -> DataFrame:
    """(node, impact, hop): seeds (node, impact) spread to neighbours (node, nbr, polarity).

    All nodes of a hop act at once, with the sign they have at its start (an impact that cancels to 0 pushes); the strength of a hop is the same for all.
    A node acts only in the hop after it was first reached.  The number of hops is fixed by `keep` and the floor.
    """
    state = seeds.select("node", F.col("impact").cast("double").alias("impact"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        if strength <= FLOOR:
            break
        strength *= keep
        acting = state.where(F.col("hop") == hop - 1).select("node", F.when(F.col("impact") >= 0, 1).otherwise(-1).alias("sign"))
        given = acting.join(adjacency, "node").groupBy("nbr").agg(F.sum(F.col("sign") * F.col("polarity") * strength).alias("given"))
        state = state.join(given.withColumnRenamed("nbr", "node"), "node", "full_outer").select(
            "node", (F.coalesce("impact", F.lit(0.0)) + F.coalesce("given", F.lit(0.0))).alias("impact"), F.coalesce("hop", F.lit(hop)).alias("hop")
        )
    return state


def strongest(seeds: DataFrame, adjacency: DataFrame, keep: float = 0.6, hops: int = HOPS, k: int = 3) -> DataFrame:
    """Top k by summed strength, where each node passes on the largest strength that reached it in the hop before."""
    front = seeds.select("node", F.col("impact").cast("double").alias("s"))
    total = front
    for _ in range(hops):
        sent = front.where(F.col("s") * keep > FLOOR).join(adjacency, "node").select(F.col("nbr").alias("node"), (F.col("s") * keep).alias("s"))
        total = total.unionByName(sent)
        front = sent.groupBy("node").agg(F.max("s").alias("s"))
    return total.groupBy("node").agg(F.sum("s").alias("score")).orderBy(F.desc(F.round("score", 9)), "node").limit(k)


def rewires(impact: DataFrame, adjacency: DataFrame, limit: int = LINKS, parts: int | None = None) -> DataFrame:
    """Links between nodes next to each other in the order of impact that are no neighbours yet and of one sign.
    Ranking is over the top nodes only: those with an impact of at least LINK.  The order is cut into ranges (`parts`, or as
    many as a shuffle has), each of which knows the last node before it."""
    ranked = impact.where(F.abs("impact") >= LINK).select((-F.abs("impact")).alias("by"), "node", "impact")
    ranges = ranked.repartitionByRange(*([parts] if parts else []), "by", "node").withColumn("range", F.spark_partition_id())
    rows, w = carried(saved(ranges), [], ["by", "node"], F.col("range"), last=("node", "impact"))
    pairs = own(rows.select("*", (number(w) - 1).cast("int").alias("rank"), F.lag("node").over(w).alias("first"), F.lag("impact").over(w).alias("was")))
    pairs = pairs.where("first is not null and impact * was >= 0").select("rank", F.col("first").alias("node"), F.col("node").alias("nbr"))
    fits = pairs.join(adjacency.select("node", "nbr").distinct(), ["node", "nbr"], "left_anti")
    return fits.select("rank", "node", "nbr").orderBy("rank").limit(limit)


def state_vectors(incident: DataFrame, total: DataFrame) -> DataFrame:
    """Six features of every entity from its incident edges (entity, nbr, layer), in two aggregations; total: one row with
    the number of nodes.

    entropy of the neighbours, share of temporal edges, number of spatial edges, edges, share of the other nodes that
    are neighbours, distinct layers an edge; and the distinct neighbours and layers themselves.
    """
    per = incident.groupBy("entity", "nbr").agg(F.count("*").alias("n"), F.count_if(F.col("layer") == "temporal").alias("t"), F.count_if(F.lower("layer").isin("spatial", "location", "place")).alias("s"), F.collect_set("layer").alias("layers"))
    row = per.groupBy("entity").agg(
        F.sum("n").alias("edges"), F.sum("t").alias("temporal"), F.sum("s").alias("spatial"), F.count("*").alias("nbrs"), F.array_distinct(F.flatten(F.collect_set("layers"))).alias("layers"),
        F.collect_list("n").alias("counts"),
    )
    p = lambda n: n / F.col("edges")
    entropy = F.aggregate("counts", F.lit(0.0), lambda acc, n: acc - p(n) * F.log(p(n) + 1e-9))
    row = row.join(F.broadcast(total.toDF("nodes")))
    return row.select(
        "entity", entropy.alias("social_entropy"), F.least(F.lit(1.0), F.col("temporal") / F.col("edges")).alias("temporal_regularity"), F.col("spatial").alias("spatial_range"),
        F.col("edges").alias("schedule_density"), (F.col("nbrs") / F.greatest(F.lit(1), F.col("nodes") - 1)).alias("network_centrality"), (F.size("layers") / F.col("edges")).alias("transition_speed"),
        F.col("nbrs").alias("neighbours"), F.size("layers").cast("long").alias("n_layers"),
    )
