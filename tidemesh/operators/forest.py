"""Spanning forests of large graphs, and what follows from them: cycles, common ancestors, bridges.

A graph is a table of pairs (u, v), u <> v, in which a pair may stand in any direction and repeatedly.  The trees are
those of a search in breadth, so they are as shallow as the graph allows: their depth is at most its diameter, and the
number of rounds grows with that.  Each level, and each table of ancestors, is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt, saved, scratch
from .topology import linked


def simple(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("nbr")).unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("nbr")))


def spanning(pairs: DataFrame) -> DataFrame:
    """(node, parent, depth, root) of every node with an edge.  A tree's root is the smallest node of its component and has
    no parent; the parent of another node is its smallest neighbour in the level above."""
    with scratch(pairs.sparkSession) as keep:
        return keep(_searched(dealt(_both(simple(pairs)), "node")))


def _searched(adjacency: DataFrame) -> DataFrame:
    with scratch(adjacency.sparkSession) as keep:
        labels = linked(adjacency)
        parent = F.lit(None).cast(dict(adjacency.dtypes)["node"])
        level = saved(labels.where("node = component").select("node", parent.alias("parent"), F.lit(0).alias("depth"), F.col("component").alias("root")))
        done, above, depth = level, None, 0
        while not level.isEmpty():
            reached = level.select("node", "root").join(adjacency, "node").groupBy("nbr").agg(F.min("node").alias("parent"), F.min("root").alias("root"))
            # neighbours of a level lie in it, in the one above or in the next
            known = level.select("node") if above is None else level.select("node").unionByName(above.select("node"))
            fresh = reached.withColumnRenamed("nbr", "node").join(known, "node", "left_anti")
            depth += 1
            above, level = level, saved(fresh.select("node", "parent", F.lit(depth).alias("depth"), "root"))
            done = done.unionByName(level)
        return keep(saved(done))


def ancestors(forest: DataFrame) -> list[DataFrame]:
    """(node, up) of each node's ancestor 1, 2, 4, ... levels above, as long as any node has one."""
    out = [saved(forest.where("parent is not null").select("node", F.col("parent").alias("up")))]
    while not out[-1].isEmpty():
        last = out[-1]
        out.append(saved(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))))
    return out[:-1]


def meeting(pairs: DataFrame, forest: DataFrame, up: list[DataFrame]) -> DataFrame:
    """(u, v, meet): the lowest common ancestor of two nodes of one tree, by jumps that halve."""
    depth = forest.select("node", "depth")
    rows = pairs.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b"))
    for x in "ab":
        rows = rows.join(depth.select(F.col("node").alias(x), F.col("depth").alias("d_" + x)), x)
    # the deeper node is a
    deeper = F.col("d_a") >= F.col("d_b")
    rows = rows.select("u", "v", F.when(deeper, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(deeper, F.col("b")).otherwise(F.col("a")).alias("b"), F.abs(F.col("d_a") - F.col("d_b")).alias("gap"))
    for k in range(len(up) - 1, -1, -1):
        rows = rows.join(up[k].select(F.col("node").alias("a"), "up"), "a", "left")
        jump = F.col("gap") >= 2**k
        rows = rows.select("u", "v", F.when(jump, F.col("up")).otherwise(F.col("a")).alias("a"), "b", (F.col("gap") - F.when(jump, 2**k).otherwise(0)).alias("gap"))
    rows = saved(rows.drop("gap"))
    for k in range(len(up) - 1, -1, -1):
        rows = rows.join(up[k].select(F.col("node").alias("a"), F.col("up").alias("up_a")), "a", "left").join(up[k].select(F.col("node").alias("b"), F.col("up").alias("up_b")), "b", "left")
        jump = (F.col("a") != F.col("b")) & (F.col("up_a") != F.col("up_b"))
        rows = rows.select("u", "v", F.when(jump, F.col("up_a")).otherwise(F.col("a")).alias("a"), F.when(jump, F.col("up_b")).otherwise(F.col("b")).alias("b"))
    rows = saved(rows)
    parent = forest.select(F.col("node").alias("a"), "parent")
    return rows.join(parent, "a").select("u", "v", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("parent")).alias("meet"))


def others(pairs: DataFrame, forest: DataFrame) -> DataFrame:
    """The edges (u < v) that are not in the forest; each closes one cycle."""
    tree = forest.where("parent is not null").select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    return simple(pairs).join(tree, ["u", "v"], "left_anti")


def cycles(pairs: DataFrame, forest: DataFrame) -> DataFrame:
    """(cycle_u, cycle_v, a, b): the steps of the cycle that each edge outside the forest closes, a to b in the direction
    that runs from cycle_u to cycle_v over that edge.  The result holds as many rows as the cycles are long."""
    with scratch(pairs.sparkSession) as keep:
        rest = saved(others(pairs, forest))
        met = saved(meeting(rest, forest, ancestors(forest)))
        parents = forest.where("parent is not null").select("node", "parent")
        out = rest.select(F.col("u").alias("cycle_u"), F.col("v").alias("cycle_v"), F.col("u").alias("a"), F.col("v").alias("b"))
        # from v up to the meeting point, and from there down to u
        for start, down in (("v", False), ("u", True)):
            at = saved(met.select("u", "v", F.col(start).alias("node"), "meet").where("node <> meet"))
            while not at.isEmpty():
                at = at.join(parents, "node")
                step = (F.col("parent"), F.col("node")) if down else (F.col("node"), F.col("parent"))
                out = out.unionByName(at.select(F.col("u").alias("cycle_u"), F.col("v").alias("cycle_v"), step[0].alias("a"), step[1].alias("b")))
                at = saved(at.select("u", "v", F.col("parent").alias("node"), "meet").where("node <> meet"))
        return keep(saved(out))


def bridges(pairs: DataFrame) -> DataFrame:
    """(u, v), u < v: the edges without which their component falls apart.  A pair that stands more than once, in whatever
    direction, is no bridge.

    Each edge has two hashes of 64 bits, others if it stands more than once.  Over all ends of edges in a subtree of the
    forest, exclusive or leaves those that leave the subtree, as edges inside have both ends there; the edge above the
    subtree is a bridge where its own hashes are all that is left.  That other edges' hashes cancel out by chance has odds
    of 2^-128 an edge.  The subtrees are summed up level by level, so that a node is dealt out to its parent once.
    """
    with scratch(pairs.sparkSession) as keep:
        once = pairs.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg((F.count("*") > 1).alias("more"))
        ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("node"), F.col("u").alias("nbr")))
        adjacency = dealt(once.select(F.explode(ends).alias("e"), "more").select("e.*", "more"), "node")
        forest = _searched(adjacency)
        marks = lambda a, b, more: {x: F.xxhash64(F.lit(x), F.least(a, b), F.greatest(a, b), more) for x in ("x", "y")}
        both = adjacency.select("node", *[h.alias(x) for x, h in marks("node", "nbr", F.col("more")).items()])
        own = both.groupBy("node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        own = saved(forest.join(own, "node").select("node", "parent", "depth", "x", "y"))
        given, found = None, []
        for depth in range(own.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0], 0, -1):
            level = own.where(F.col("depth") == depth).select("node", "parent", "x", "y")
            if given is not None:
                level = level.unionByName(given).groupBy("node").agg(F.max("parent").alias("parent"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
            level = saved(level)
            bare = [F.col(x) == h for x, h in marks("node", "parent", F.lit(False)).items()]
            found.append(level.where(bare[0] & bare[1]).select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v")))
            given = level.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).withColumn("parent", F.lit(None).cast(dict(own.dtypes)["parent"]))
        out = own.limit(0).select(F.col("node").alias("u"), F.col("parent").alias("v"))
        for some in found:
            out = out.unionByName(some)
        return keep(saved(out))
