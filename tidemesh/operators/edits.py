"""Structural edits of a graph within a budget: dropped edges never cut a component or strip a node, new ones are weak.

Edges are (edge_id, ts, src, dst, layer, weight).  What is asked for are short ordered lists of pairs on the driver; the
graph itself stays a table, written once for each edit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved, scratch
from .forest import bridges
from .planning import clip

#: Edits a cycle, the weight of a new edge.
MOST, NEW_WEIGHT, NEW_LAYER = 2, 0.07, "adaptive"


@dataclass(frozen=True)
class Edits:
    added: int
    dropped: int
    blocked: int


def allowed(requested: int, risk: float, density: float, slowing: float, multiplier: float = 1.0, most: int = MOST) -> int:
    """How many of the requested edits are made: fewer at risk and when the graph recovers slowly, more in dense graphs."""
    scale = (1 - 0.7 * clip(risk)) * (0.8 + 0.4 * clip(density)) * (1 - 0.5 * clip(slowing)) * max(0.25, min(1.25, multiplier))
    return max(0, min(requested, max(0, round(most * scale))))


def shared(budget: int, n_drops: int, n_new: int, drop_bias: float = 1.0, new_bias: float = 1.0) -> tuple[int, int]:
    """(drops, new edges) of a budget; halves go to the even number, so of one edit with equal biases none is a drop."""
    new, drop = max(0.1, new_bias), max(0.1, drop_bias)
    drops = min(n_drops, round(budget * drop / (new + drop)))
    return drops, min(n_new, budget - drops)


def drop(edges: DataFrame, pairs: list[tuple]) -> tuple[DataFrame, int, int]:
    """(edges, dropped, blocked): of each pair in turn the edge of the lowest weight goes (ties: the earlier, then the
    smaller id).  A pair without an edge is passed over.  Blocked is an edge that is the last one of a node or whose loss
    would split a component; a self-loop never is.  The bridges are found once for each state of the graph that is asked
    about, not by a run over the components for each edge."""
    dropped = blocked = 0
    cuts = None
    for u, v in pairs:
        same = ((F.col("src") == u) & (F.col("dst") == v)) | ((F.col("src") == v) & (F.col("dst") == u))
        touches = lambda x: F.count_if((F.col("src") == x) | (F.col("dst") == x))
        m = edges.agg(F.count_if(same).alias("n"), touches(u).alias("d_u"), touches(v).alias("d_v"), F.min_by(F.when(same, F.col("edge_id")), F.when(same, F.struct("weight", "ts", "edge_id"))).alias("least")).first()
        if not m.n:
            continue
        if u != v:
            if min(m.d_u, m.d_v) <= 1:
                blocked += 1
                continue
            if m.n == 1:
                if cuts is None:
                    cuts = bridges(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
                if not cuts.where(((F.col("u") == u) & (F.col("v") == v)) | ((F.col("u") == v) & (F.col("v") == u))).isEmpty():
                    blocked += 1
                    continue
        edges, cuts = saved(edges.where(F.col("edge_id") != m.least)), None
        dropped += 1
    return edges, dropped, blocked


def add(edges: DataFrame, pairs: list[tuple]) -> tuple[DataFrame, int]:
    """(edges, added): pairs that have no edge yet get a weak one, a second apart, behind the latest edge; a pair of one
    node gets none."""
    if not pairs:
        return edges, 0
    ends = F.array(F.least("src", "dst"), F.greatest("src", "dst"))
    asked = [(min(p), max(p)) for p in pairs]
    m = edges.agg(F.count("*").alias("n"), F.coalesce(F.max("ts"), F.current_timestamp()).alias("ts")).first()
    known = {tuple(r[0]) for r in edges.where(F.greatest(*[(ends[0] == a) & (ends[1] == b) for a, b in asked], F.lit(False))).select(ends).distinct().collect()}  # at most the pairs asked for
    added = 0
    for k, ((a, b), key) in enumerate(zip(pairs, asked)):
        if a == b or key in known:
            continue
        row = edges.sparkSession.range(1).select(
            F.lit(f"auto_add_{m.n + added}_{k}").alias("edge_id"), (F.lit(m.ts) + F.expr(f"interval {k + 1} seconds")).cast(edges.schema["ts"].dataType).alias("ts"), F.lit(a).cast(edges.schema["src"].dataType).alias("src"),
            F.lit(b).cast(edges.schema["dst"].dataType).alias("dst"), F.lit(NEW_LAYER).alias("layer"), F.lit(NEW_WEIGHT).alias("weight"),
        )
        edges = edges.unionByName(row)
        known.add(key)
        added += 1
    return edges, added


def applied(edges: DataFrame, drops: list[tuple], new: list[tuple], budget: int, drop_bias: float = 1.0, new_bias: float = 1.0, asked_drops: int | None = None) -> tuple[DataFrame, Edits]:
    """The edges after the edits of a budget, and their numbers.  Blocked are those of the first `asked_drops` drops (as
    many as the budget has, if none is given) that the graph after all edits would not let go."""
    n_drops, n_new = shared(budget, len(drops), len(new), drop_bias, new_bias)
    with scratch(edges.sparkSession) as keep:
        edges = saved(edges.select("edge_id", "ts", "src", "dst", "layer", F.col("weight").cast("double").alias("weight")))
        edges, dropped, _ = drop(edges, drops[:n_drops])
        edges, added = add(edges, new[:n_new])
        edges = saved(edges)
        _, _, blocked = drop(edges, drops[: n_drops if asked_drops is None else asked_drops])
        return keep(edges), Edits(added, dropped, blocked)
