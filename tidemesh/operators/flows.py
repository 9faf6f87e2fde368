"""Decomposition of edge flows into a gradient, a curl on the cycles and a harmonic rest.

Potentials come from conjugate gradients over tables: a vector is a table (node, value), the product with the Laplacian
an aggregation over edge ends, and the step lengths come from one row of sums a round, all that the driver sees.  Each
round is written to the shared folder.  No graph is gathered anywhere.

Edges are (ord, src, dst, flow): parallel edges and self-loops are edges of their own, ord tells edges apart and orders
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved, scratch

#: A fixed value: what is added to the diagonal.
RIDGE = 1e-6


def edge_flow(edges: DataFrame, impact: DataFrame) -> DataFrame:
    """(ord, src, dst, flow): the rise of impact along each edge and 0.05 of its weight; nodes without an impact have 0."""
    rows = edges.select("ord", "src", "dst", "weight")
    for x in ("src", "dst"):
        rows = rows.join(impact.select(F.col("node").alias(x), F.col("impact").alias("i_" + x)), x, "left")
    return rows.select("ord", "src", "dst", (F.coalesce("i_dst", F.lit(0.0)) - F.coalesce("i_src", F.lit(0.0)) + 0.05 * F.col("weight")).alias("flow"))


def divergence(flows: DataFrame) -> DataFrame:
    """(node, div): what flows in less what flows out; a self-loop adds nothing, but its node is listed."""
    ends = F.array(F.struct(F.col("dst").alias("node"), F.col("flow").alias("f")), F.struct(F.col("src").alias("node"), (-F.col("flow")).alias("f")))
    return flows.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.f").alias("div"))


def solve(pairs: DataFrame, right: DataFrame, pinned=None, ridge: float = RIDGE, tolerance: float = 1e-12, most: int = 10_000) -> DataFrame:
    """(node, x) with (L + ridge) x = right, L being the Laplacian of pairs (u, v, n) with n parallel edges.

    right: (node, b), every node once.  The pinned node keeps 0.  Without one, `right` must sum to 0 over each component,
    as a divergence does; x then sums to 0 there.  Ends when the rest is at most `tolerance` of the right side; if that
    takes more than `most` rounds, an error is raised."""
    both = pairs.where("u <> v").select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("node"), F.col("u").alias("nbr")))).alias("e"), "n").select("e.*", "n")
    with scratch(right.sparkSession) as keep:
        links = saved(both.groupBy("node", "nbr").agg(F.sum("n").alias("n")))
        free = F.lit(True) if pinned is None else ~F.col("node").eqNullSafe(F.lit(pinned))
        degree = links.groupBy("node").agg(F.sum("n").alias("d"))
        start = right.join(degree, "node", "left").select("node", (F.coalesce("d", F.lit(0)) + ridge).alias("d"), F.when(free, F.col("b")).otherwise(0.0).alias("b"))
        d = F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)
        state = start.select("node", d.alias("d"), F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / d).alias("p"))
        links = links.where(free & (F.lit(True) if pinned is None else ~F.col("nbr").eqNullSafe(F.lit(pinned))))
        goal = None
        state = saved(state)
        for _ in range(most):
            pulled = links.join(state.select(F.col("node").alias("nbr"), F.col("p").alias("s")), "nbr").groupBy("node").agg(F.sum(F.col("n") * F.col("s")).alias("s"))
            state = saved(state.join(pulled, "node", "left").withColumn("q", F.when(free, F.col("d") * F.col("p") - F.coalesce("s", F.lit(0.0))).otherwise(0.0)).drop("s"))
            p, q, r = F.col("p"), F.col("q"), F.col("r")
            m = state.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in {"pq": p * q, "rz": r * r / F.col("d"), "rqz": r * q / F.col("d"), "qqz": q * q / F.col("d"), "rr": r * r}.items()]).first()
            goal = m.rr if goal is None else goal
            if m.rr <= goal * tolerance * tolerance or m.pq <= 0:
                return keep(saved(state.select("node", "x")))
            a = m.rz / m.pq
            b = max(0.0, (m.rz - 2 * a * m.rqz + a * a * m.qqz) / m.rz)
            rest = r - a * q
            state = state.select("node", "d", (F.col("x") + a * p).alias("x"), rest.alias("r"), (rest / F.col("d") + b * p).alias("p"))
        raise ArithmeticError(f"no solution after {most} rounds")


def potential(flows: DataFrame, pinned) -> DataFrame:
    """(node, phi): the potential whose rise along the edges comes nearest to the flow; the pinned node has 0."""
    pairs = flows.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("n"))
    return solve(pairs, divergence(flows).withColumnRenamed("div", "b"), pinned).withColumnRenamed("x", "phi")


def _rise(edges: DataFrame, phi: DataFrame, name: str) -> DataFrame:
    for x in ("src", "dst"):
        edges = edges.join(phi.select(F.col("node").alias(x), F.col(phi.columns[1]).alias("h_" + x)), x)
    return edges.withColumn(name, F.col("h_dst") - F.col("h_src")).drop("h_src", "h_dst")


def curl(rest: DataFrame) -> DataFrame:
    """(ord, curl): of the flows (ord, src, dst, flow) the part that runs in cycles of the simple graph, on the last edge
    of each unordered pair; other edges, and self-loops, have none.

    The cycle space is what is orthogonal to all gradients, so its projection is the flow less its own gradient, whatever
    basis of cycles is taken; `forest.cycles` gives one."""
    last = rest.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max_by(F.struct("ord", "src", "dst", "flow"), "ord").alias("e"))
    edges = saved(last.select("e.*"))
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("n"))
    psi = solve(pairs, divergence(edges).withColumnRenamed("div", "b"), ridge=0.0)
    return _rise(edges, psi, "rise").select("ord", (F.col("flow") - F.col("rise")).alias("curl"))


def decompose(flows: DataFrame, pinned) -> tuple[DataFrame, DataFrame]:
    """(edges, potentials): (ord, src, dst, flow, gradient, curl, harmonic), whose last three sum to the flow, and (node,
    phi).  Of the tables that have a row for each edge only the flows are written; gradient and curl are joined to them
    where they are read."""
    with scratch(flows.sparkSession) as keep:
        flows = keep(saved(flows))
        phi = keep(saved(potential(flows, pinned)))
        edges = _rise(flows, phi, "gradient")
        turning = keep(saved(curl(edges.select("ord", "src", "dst", (F.col("flow") - F.col("gradient")).alias("flow")))))
        rows = edges.join(turning, "ord", "left").fillna(0.0, ["curl"])
        return rows.select("ord", "src", "dst", "flow", "gradient", "curl", (F.col("flow") - F.col("gradient") - F.col("curl")).alias("harmonic")), phi


def norms(edges: DataFrame) -> DataFrame:
    """One row: the norms of a decomposed flow and its parts, and the ratios of curl, harmonic and both to the flow."""
    size = lambda c: F.coalesce(F.sqrt(F.sum(c * c)), F.lit(0.0))
    parts = {c: size(F.col(c)) for c in ("flow", "gradient", "curl", "harmonic")} | {"residual": size(F.col("curl") + F.col("harmonic"))}
    rows = edges.agg(*[x.alias(c) for c, x in parts.items()])
    return rows.withColumns({f"{c}_ratio": F.col(c) / (F.col("flow") + 1e-9) for c in ("curl", "harmonic", "residual")})
