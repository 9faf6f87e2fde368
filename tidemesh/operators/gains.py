"""Control of a graph's nodes with gains that look ahead and adapt from cycle to cycle.

All that grows with the graph is one table of node terms and aggregations over it; the gains themselves are a few
numbers that go from one cycle to the next.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved, scratch
from . import flows, topology


@dataclass(frozen=True)
class Gains:
    div: float = 0.35
    residual: float = 0.5
    higher: float = 0.1
    #: What the cycle before came to, and the directions its gains went.
    objective: float | None = None
    way_div: float = 1.0
    way_residual: float = 1.0


@dataclass(frozen=True)
class Settings:
    # Fixed values of the control of nodes.
    phi: float = 0.15
    speed: float = 0.2
    cycle: float = 0.12
    curl: float = 0.18
    harmonic: float = 0.16
    target_speed: float = 0.45
    limit: float = 1.0
    step_div: float = 0.02
    step_residual: float = 0.015
    step_higher: float = 0.01
    horizon: int = 2
    decay: float = 0.7


# The control of clusters, where its gains begin, and the bounds of the gains.
COARSE = Settings(phi=0.12, speed=0.12, cycle=0.1, curl=0.12, harmonic=0.1, target_speed=0.4, limit=0.8)
COARSE_GAINS = Gains(div=0.28, residual=0.45, higher=0.06)
BOUNDS = {"div": (0.1, 1.2), "residual": (0.2, 0.9), "higher": (0.02, 0.6)}


def _held(name: str, x: float) -> float:
    low, high = BOUNDS[name]
    return min(high, max(low, x))


def _unit(x: float) -> float:
    return max(0.0, min(1.0, float(x)))


def clamped(g: Gains, risk: float) -> Gains:
    """Weaker gains at risk; none changes without risk."""
    r = _unit(risk)
    if r <= 1e-6:
        return g
    return replace(g, div=_held("div", g.div * (1 - 0.22 * r)), residual=_held("residual", g.residual * (1 - 0.18 * r)), higher=_held("higher", g.higher * (1 - 0.2 * r)))


def adapted(g: Gains, s: Settings, m: dict[str, float]) -> Gains:
    """The gains of the next cycle, from the objective, residual_ratio, div_before, div_after, energy and saturation of this
    one."""
    div, residual, higher = g.div, g.residual, g.higher
    ways = (g.way_div, g.way_residual)
    if g.objective is not None:
        if m["objective"] >= g.objective:
            ways = (-ways[0], -ways[1])
        div, residual = div + ways[0] * s.step_div, residual + ways[1] * s.step_residual
    if m["residual_ratio"] > 0.45 or m["div_after"] >= 0.97 * m["div_before"]:
        div, residual, higher = min(BOUNDS["div"][1], div * 1.03), min(BOUNDS["residual"][1], residual * 1.02), min(BOUNDS["higher"][1], higher * 1.01)
    else:
        div, residual, higher = max(BOUNDS["div"][0], div * 0.995), max(BOUNDS["residual"][0], residual * 0.995), max(BOUNDS["higher"][0], higher * 0.997)
    if m["energy"] > 2.5 or m["saturation"] > 0.35:
        div, residual, higher = div * 0.97, residual * 0.985, higher * 0.985
    return Gains(_held("div", div), _held("residual", residual), _held("higher", higher), m["objective"], *ways)


def node_terms(nodes: DataFrame, edges: DataFrame, impact: DataFrame, pinned) -> tuple[DataFrame, dict[str, float]]:
    """What the control of each node is made of, and the measures of the whole graph.

    nodes: (node); edges: (ord, src, dst, weight); impact: (node, impact).  The table has impact, div, turn and still (the
    divergence of curl and harmonic, and of the harmonic alone), phi, cycle, higher, curl and harmonic of every node."""
    with scratch(nodes.sparkSession) as keep:
        parts, phi = flows.decompose(flows.edge_flow(edges, impact), pinned)
        pairs = saved(edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())
        three = saved(topology.triangles(pairs))
        four = saved(topology.four_cliques(three, pairs))
        degrees = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("simple"))
        part = topology.participation(nodes.select("node"), three, four)
        local = topology.clustering(part, degrees).select("node", (F.coalesce(F.try_divide("triangles", "wedges"), F.lit(0.0))).alias("local"))
        named = lambda df, name: df.select("node", F.col(df.columns[1]).alias(name))
        of = lambda c: parts.select("src", "dst", c.alias("flow"))
        columns = {
            "impact": impact.select("node", "impact"), "div": flows.divergence(parts), "turn": flows.divergence(of(F.col("curl") + F.col("harmonic"))), "still": flows.divergence(of(F.col("harmonic"))), "phi": phi,
            "cycle": local, "higher": topology.simplex_pressure(impact, three, four), "curl": topology.flow_pressure(of(F.col("curl"))), "harmonic": topology.flow_pressure(of(F.col("harmonic"))),
        }
        rows = nodes.select("node").distinct()
        for name, df in columns.items():
            rows = rows.join(named(df, name), "node", "left")
        rows = rows.fillna(0.0, list(columns)).withColumn("cycle", F.col("cycle") * F.col("impact"))
        rows = keep(saved(rows))
        measures = flows.norms(parts).first().asDict()
        shape = topology.simplex_tension(part).first()
        measures |= {"simplex_density": shape.density or 0.0, "tension": shape.tension or 0.0}
        means = rows.agg(F.coalesce(F.avg(F.abs("cycle")), F.lit(0.0)).alias("cycle_mean"), F.coalesce(F.avg(F.abs("higher")), F.lit(0.0)).alias("higher_mean"), F.coalesce(F.sqrt(F.sum(F.col("div") * F.col("div"))), F.lit(0.0)).alias("div_before"))
        return rows, measures | means.first().asDict()


def objective(div_after, energy, saturation, m: dict[str, float]):
    """Lower is better; also of columns."""
    rest = 0.6 * m["residual_ratio"] + 0.2 * m["cycle_mean"] + 0.45 * m["curl_ratio"] + 0.35 * m["harmonic_ratio"] + 0.25 * m["higher_mean"] + 0.15 * m["tension"]
    return 1.0 * div_after + 0.25 * energy + 0.35 * saturation + rest


def _control(div, speed, kd, kh, limit, s: Settings):
    u = -kd * div - s.phi * F.col("phi") - s.speed * speed - s.cycle * F.col("cycle") - kh * F.col("higher") - s.curl * F.col("curl") - s.harmonic * F.col("harmonic")
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), u))


def candidates(terms: DataFrame, g: Gains, m: dict[str, float], speed: float, s: Settings = Settings()) -> DataFrame:
    """(ord, div, residual, higher, total): 27 settings about the gains, and what each comes to over the steps ahead, later
    steps counting less.  Controls are held to the limit as it is without risk."""
    grid = [(_held("div", g.div + i * s.step_div), _held("residual", g.residual + j * s.step_residual), _held("higher", g.higher + k * s.step_higher)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    spark = terms.sparkSession
    grid = spark.createDataFrame([(n, *x) for n, x in enumerate(grid)], "ord int, kd double, rd double, kh double")
    rows = terms.crossJoin(F.broadcast(grid))  # 27 rows
    before, turned, sums, ahead = F.col("div"), F.col("rd"), [], speed - s.target_speed
    for n in range(s.horizon):
        after = before - turned * F.col("turn") - s.harmonic * F.col("still")
        u = _control(before, ahead, F.col("kd"), F.col("kh"), s.limit, s)
        sums += [F.sum(after * after).alias(f"after{n}"), F.sum(u * u).alias(f"energy{n}"), F.avg((F.abs(u) >= 0.98 * s.limit).cast("double")).alias(f"saturated{n}")]
        before, turned, ahead = after, turned * F.col("rd"), ahead * s.decay
    total = sum((s.decay**n * objective(F.sqrt(f"after{n}"), F.col(f"energy{n}"), F.col(f"saturated{n}"), m) for n in range(s.horizon)), F.lit(0.0))
    return rows.groupBy("ord", F.col("kd").alias("div"), F.col("rd").alias("residual"), F.col("kh").alias("higher")).agg(*sums).select("ord", "div", "residual", "higher", total.alias("total"))


def control(terms: DataFrame, m: dict[str, float], g: Gains, speed: float, risk: float = 0.0, s: Settings = Settings()) -> tuple[DataFrame, dict[str, float], Gains]:
    """((node, control, controlled), measures, gains of the next cycle) of one cycle.

    The best candidate (the first of equal ones) is made safe for the risk before it is used, and what adaptation makes of
    it once more."""
    best = candidates(terms, g, m, speed, s).orderBy("total", "ord").first()
    g = clamped(replace(g, div=best["div"], residual=best.residual, higher=best.higher) if best else g, risk)
    limit = max(0.35, s.limit * (1 - 0.35 * _unit(risk)))
    u = _control(F.col("div"), speed - s.target_speed, F.lit(g.div), F.lit(g.higher), limit, s)
    after = F.col("div") - g.residual * F.col("turn") - s.harmonic * F.col("still")
    rows = terms.select("node", "impact", u.alias("u"), after.alias("after"))
    out = rows.agg(F.coalesce(F.sqrt(F.sum(F.col("after") * F.col("after"))), F.lit(0.0)).alias("div_after"), F.coalesce(F.sum(F.col("u") * F.col("u")), F.lit(0.0)).alias("energy"), F.coalesce(F.avg((F.abs("u") >= 0.98 * limit).cast("double")), F.lit(0.0)).alias("saturation")).first().asDict()
    out = m | out | {"gain_div": g.div, "gain_residual": g.residual, "gain_higher": g.higher}
    out["objective"] = objective(out["div_after"], out["energy"], out["saturation"], m)
    moved = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("impact") + F.round("u", 6)))
    return rows.select("node", F.round("u", 6).alias("control"), moved.alias("controlled")), out, clamped(adapted(g, s, out), risk)
