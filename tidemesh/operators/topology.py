"""Triangles, four-cliques and what they press on nodes; flows and their divergence; contraction to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt, saved, scratch


def triangles(pairs: DataFrame) -> DataFrame:
    """(a, b, c) of a simple graph given as pairs u < v.  Edges run from the end of smaller degree to the larger, so a
    hub opens few wedges; the closing edge is a semi join."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    du, dv = (ends.select(F.col("n").alias(x), F.col("d").alias("d" + x)) for x in "uv")
    low = F.struct("du", "u") < F.struct("dv", "v")
    arcs = pairs.join(du, "u").join(dv, "v").select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("t"))
    wedge = arcs.select("s", F.col("t").alias("t1")).join(arcs.select("s", F.col("t").alias("t2")), "s").where("t1 < t2")
    closed = wedge.join(pairs.select(F.col("u").alias("t1"), F.col("v").alias("t2")), ["t1", "t2"], "left_semi")
    members = F.sort_array(F.array("s", "t1", "t2"))
    return closed.select(members[0].alias("a"), members[1].alias("b"), members[2].alias("c"))


def four_cliques(three: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, c, d): two triangles on one edge whose other corners are joined."""
    other = three.select("a", "b", F.col("c").alias("d"))
    both = three.join(other, ["a", "b"]).where("c < d")
    return both.join(pairs.select(F.col("u").alias("c"), F.col("v").alias("d")), ["c", "d"], "left_semi").select("a", "b", "c", "d")


def participation(nodes: DataFrame, three: DataFrame, four: DataFrame) -> DataFrame:
    """Triangles and four-cliques of every node, zeros included."""
    t = three.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    q = four.select(F.explode(F.array("a", "b", "c", "d")).alias("node")).groupBy("node").agg(F.count("*").alias("cliques"))
    return nodes.join(t, "node", "left").join(q, "node", "left").fillna(0, ["triangles", "cliques"])


def clustering(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Closed wedges and wedges of every node (participation and simple degrees beside it)."""
    return nodes.join(degrees, "node").select("node", "triangles", (F.col("simple") * (F.col("simple") - 1) / 2).cast("long").alias("wedges"))


def divergence(edges: DataFrame, impact: DataFrame) -> DataFrame:
    """(node, div): inflow less outflow of f = I(dst) - I(src) + 0.05 w, self-loops left out; one pass over edge ends."""
    at = lambda x: impact.select(F.col("node").alias(x), F.col("impact").alias("i_" + x))
    flow = edges.where("src <> dst").join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    f = F.coalesce("i_dst", F.lit(0.0)) - F.coalesce("i_src", F.lit(0.0)) + 0.05 * F.col("weight")
    ends = F.array(F.struct(F.col("dst").alias("node"), f.alias("f")), F.struct(F.col("src").alias("node"), (-f).alias("f")))
    return flow.select(F.explode(ends).alias("e")).groupBy(F.col("e.node").alias("node")).agg(F.sum("e.f").alias("div"))


def contracted(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """(c1, c2, n): edges between clusters, from (node, cluster)."""
    a, b = (cluster.select(F.col("node").alias(x), F.col("cluster").alias("c_" + x)) for x in ("src", "dst"))
    rows = edges.join(a, "src").join(b, "dst").where("c_src <> c_dst")
    return rows.groupBy(F.least("c_src", "c_dst").alias("c1"), F.greatest("c_src", "c_dst").alias("c2")).agg(F.count("*").alias("n"))


def cluster_impact(values: DataFrame) -> DataFrame:
    """(cluster, n, total, absolute, largest): what a cluster's signed value is made of, from (cluster, value)."""
    largest = F.max_by("value", F.struct(F.abs("value"), "value"))
    return values.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.abs("value")).alias("absolute"), largest.alias("largest"))


def mixing(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """(node, entropy): how evenly a node's neighbours lie over clusters, in natural units."""
    n = edges.join(cluster.select(F.col("node").alias("nbr"), "cluster"), "nbr").groupBy("node", "cluster").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("node"))
    return n.withColumn("p", p).groupBy("node").agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-12)).alias("entropy"))


def simplex_pressure(impact: DataFrame, three: DataFrame, four: DataFrame) -> DataFrame:
    """(node, pressure): of each simplex 0.5 of the node's impact and 0.5 of the mean, triangles weighing 0.6 and
    four-cliques 1, over the largest sum.  A simplex is gathered by its at most four members."""
    simplexes = three.select(F.array("a", "b", "c").alias("members"), F.lit(0.6).alias("w")).unionByName(four.select(F.array("a", "b", "c", "d").alias("members"), F.lit(1.0).alias("w")))
    each = simplexes.select("members", "w", F.explode("members").alias("node")).join(impact, "node", "left").fillna(0.0, ["impact"])
    whole = each.groupBy("members", "w").agg(F.avg("impact").alias("mean"), F.collect_list(F.struct("node", "impact")).alias("each"))
    parts = whole.select("w", "mean", F.explode("each").alias("e"))
    sums = parts.groupBy(F.col("e.node").alias("node")).agg(F.sum(F.col("w") * (0.5 * F.col("e.impact") + 0.5 * F.col("mean"))).alias("s"))
    top = sums.agg(F.max("s").alias("top"))  # one row
    return sums.join(F.broadcast(top)).select("node", F.when(F.col("top") > 1e-9, F.col("s") / F.col("top")).otherwise(F.col("s")).alias("pressure"))


def components(adjacency: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable.  Each round takes the neighbours' smallest label, then the label
    of that label, so the rounds grow with the logarithm of the diameter on most graphs; the driver sees one count.  Rounds
    are written as tables, whose size Spark reads off the files: a checkpoint keeps the estimate of the plan before it, and
    over joins of rounds that is a number whose digits multiply until the driver cannot hold it."""
    with scratch(adjacency.sparkSession) as keep:
        return keep(linked(dealt(adjacency.select("node", "nbr").distinct(), "node")))


def linked(adjacency: DataFrame) -> DataFrame:
    """The same of distinct links that `dealt` has written by node.  Only nodes whose label changed tell their neighbours."""
    with scratch(adjacency.sparkSession) as keep:
        labels = saved(adjacency.groupBy("node").agg(F.least("node", F.min("nbr")).alias("component")))
        told = labels
        while True:
            near = adjacency.join(told.select("node", F.col("component").alias("c")), "node").groupBy(F.col("nbr").alias("node")).agg(F.min("c").alias("c"))
            step = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "c").alias("c"))
            jump = labels.select(F.col("node").alias("c"), F.col("component").alias("next"))
            now = saved(step.join(jump, "c", "left").select("node", "was", F.least("c", F.coalesce("next", "c")).alias("component")))
            labels, told = now.select("node", "component"), now.where("was <> component")
            if told.isEmpty():
                keep(now)
                labels._path = now._path
                return labels


def simplex_tension(participation: DataFrame) -> DataFrame:
    """One row: simplexes a node (four-cliques twice), and the variance of 1 a triangle and 1.5 a four-clique."""
    own = F.col("triangles") + 1.5 * F.col("cliques")
    density = (F.sum("triangles") / 3 + 2 * F.sum("cliques") / 4) / F.greatest(F.lit(1), F.count("*"))
    return participation.agg(density.alias("density"), F.coalesce(F.var_pop(own), F.lit(0.0)).alias("tension"))


def flow_pressure(flows: DataFrame) -> DataFrame:
    """(node, pressure): absolute flow of all edges (src, dst, flow) at a node, self-loops twice, over the largest sum if
    that is above 1."""
    sums = flows.select(F.explode(F.array("src", "dst")).alias("node"), F.abs("flow").alias("f")).groupBy("node").agg(F.sum("f").alias("s"))
    return sums.join(F.broadcast(sums.agg(F.max("s").alias("top")))).select("node", (F.col("s") / F.greatest(F.lit(1.0), F.col("top"))).alias("pressure"))


def neighbour_jaccard(pairs: DataFrame) -> DataFrame:
    """(u, v, common, jaccard): shared neighbours of the two ends of every edge, from the triangles on it."""
    three = triangles(pairs)
    sides = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("a").alias("u"), F.col("c").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")))
    common = three.select(F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("common"))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    du, dv = (ends.select(F.col("n").alias(x), F.col("d").alias("d" + x)) for x in "uv")
    rows = pairs.select("u", "v").join(common, ["u", "v"], "left").fillna(0, ["common"]).join(du, "u").join(dv, "v")
    return rows.select("u", "v", "common", (F.col("common") / (F.col("du") + F.col("dv") - F.col("common"))).alias("jaccard"))


def node_features(pairs: DataFrame, impact: DataFrame) -> DataFrame:
    """(node, impact, degree, clustering, around): impact over the largest absolute one, ln(1 + weighted degree), weighted
    clustering (cube roots of the three weights, over the largest weight), mean impact of the neighbours."""
    three = triangles(pairs)
    top = pairs.agg(F.max("weight").alias("w_top"))
    for x, y in ("ab", "ac", "bc"):
        three = three.join(pairs.select(F.col("u").alias(x), F.col("v").alias(y), F.col("weight").alias("w_" + x + y)), [x, y])
    root = F.cbrt(F.col("w_ab") / F.col("w_top") * (F.col("w_ac") / F.col("w_top")) * (F.col("w_bc") / F.col("w_top")))
    closed = three.join(F.broadcast(top)).select(root.alias("r"), F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.sum("r").alias("r"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("node"), F.col("u").alias("nbr")))).alias("e"), "weight").select("e.*", "weight")
    at = impact.select(F.col("node").alias("nbr"), F.col("impact").alias("i"))
    around = both.join(at, "nbr", "left").groupBy("node").agg(F.sum("weight").alias("w"), F.count("*").alias("d"), F.avg(F.coalesce("i", F.lit(0.0))).alias("near"))
    largest = impact.agg(F.max(F.abs("impact")).alias("i_top")).select(F.when(F.col("i_top") > 0, F.col("i_top")).otherwise(1.0).alias("i_top"))
    rows = around.join(closed, "node", "left").join(impact, "node", "left").join(F.broadcast(largest))
    clustering = F.when(F.col("d") > 1, 2 * F.coalesce("r", F.lit(0.0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return rows.select("node", (F.coalesce("impact", F.lit(0.0)) / F.col("i_top")).alias("impact"), F.log1p("w").alias("degree"), clustering.alias("clustering"), (F.col("near") / F.col("i_top")).alias("around"))


def hybrid_edges(pairs: DataFrame, before: DataFrame, impact: DataFrame, *more: DataFrame) -> DataFrame:
    """(u, v, weight): 0.65 of the weight over the largest, 0.16 between members of an earlier cluster (node, cluster) next
    to each other by absolute impact, and further (u, v, weight), all summed."""
    top = pairs.agg(F.max("weight").alias("top"))
    structural = pairs.where("u <> v").join(F.broadcast(top)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (0.65 * F.col("weight") / F.col("top")).alias("weight"))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.abs(F.coalesce("impact", F.lit(0.0)))), "node")
    chain = before.join(impact, "node", "left").select("node", F.lead("node").over(order).alias("next")).where("next is not null")
    inert = chain.select(F.least("node", "next").alias("u"), F.greatest("node", "next").alias("v"), F.lit(0.16).alias("weight"))
    rows = structural.unionByName(inert)
    for m in more:
        rows = rows.unionByName(m)
    return rows.groupBy("u", "v").agg(F.sum("weight").alias("weight"))
