"""One adjustment of a graph to an impact: policy, affinities, plan, weights, suggestions and structural edits.

Nodes are (node), edges (edge_id, ts, src, dst, layer, weight).  The graph stays in tables; what the driver holds are single
numbers and at most six suggested pairs of a kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import saved, scratch
from . import edits, planning, plasticity, supervision
from .planning import clip

# What the measures are without a phase, a control or supervision.
CALM = {"critical": 0.0, "warning": 0.0, "broken": 0.0, "flip_rate": 0.0, "coherence": 1.0, "slowing": 0.0, "hysteresis": 0.0}
UNCONTROLLED = {"residual_ratio": 0.0, "div_after": 0.0, "energy": 0.0}
UNSUPERVISED = {"confusion": 0.0, "forgetting": 0.0, "flip_rate": 0.0, "coherence": 1.0}
#: Suggestions of a kind.
SUGGESTIONS = 6


def profile(nodes: DataFrame, edges: DataFrame, impact: DataFrame) -> dict[str, float]:
    """density: edge rows over possible pairs, 1 at most; noise: standard deviation of the impacts over their mean, 1 at most,
    and 0 where the mean is not above 0."""
    n, m = nodes.select("node").distinct().count(), edges.count()
    x = impact.agg(F.avg("impact").alias("mean"), F.stddev_pop("impact").alias("sd")).first()
    noise = 0.0 if x.mean is None or x.mean <= 1e-9 else clip(x.sd / (abs(x.mean) + 1e-9))
    return {"density": clip(m / max(1.0, n * (n - 1) / 2)), "noise": noise}


def _one(spark: SparkSession, **columns) -> dict[str, float]:
    return spark.range(1).select(*[c.cast("double").alias(k) for k, c in columns.items()]).first().asDict()


def measures(spark: SparkSession, state: dict[str, float], phase: dict[str, float] | None, control: dict[str, float] | None) -> dict[str, float]:
    """viscosity, instability, risk, coupling, slowing and hysteresis, from a state's features, a phase and a control."""
    s = lambda name: F.lit(float(state.get(name, 0.0)))
    p = {k: F.lit(float(v)) for k, v in (CALM | (phase or {})).items() if k in CALM}
    c = {k: F.lit(float(v)) for k, v in (UNCONTROLLED | (control or {})).items() if k in UNCONTROLLED}
    out = _one(
        spark, viscosity=supervision.viscosity(s("temporal_regularity"), s("schedule_density")), instability=supervision.instability(s("transition_speed"), s("social_entropy"), s("temporal_regularity")),
        risk=supervision.phase_risk(p["critical"], p["warning"], p["broken"], p["flip_rate"], p["coherence"]), coupling=supervision.coupling(c["residual_ratio"], c["div_after"], c["energy"]),
    )
    return out | {k: clip(float((CALM | (phase or {}))[k])) for k in ("slowing", "hysteresis")}


def merged(*lists: list[tuple]) -> list[tuple]:
    """Pairs of several lists in their order, each once whatever its direction, the first six."""
    return list(dict.fromkeys(tuple(sorted(p)) for pairs in lists for p in pairs))[:SUGGESTIONS]


def adjust(nodes: DataFrame, edges: DataFrame, impact: DataFrame, state: dict[str, float], memory: plasticity.Memory, phase: dict[str, float] | None = None, control: dict[str, float] | None = None, supervised: dict[str, float] | None = None, most: int = edits.MOST, anchors: int = plasticity.ANCHORS, settings: dict | None = None) -> tuple[DataFrame, plasticity.Memory, dict]:
    """(edges, memory, report) of a cycle.  `most` is the number of structural edits a cycle may make; none with 0.
    `settings` may name others than the fixed values of `planning.PLANNER` and `supervision.KNOBS`."""
    spark = nodes.sparkSession
    own = lambda df, fixed: df.withColumns({k: F.array(*map(F.lit, v)) if isinstance(v, (tuple, list)) else F.lit(v) for k, v in (settings or {}).items() if k in fixed})
    with scratch(spark) as keep:
        m = measures(spark, state, phase, control) | profile(nodes, edges, impact)
        told = UNSUPERVISED | (supervised or {})
        knobs = supervision.policy(own(spark.createDataFrame([tuple(float(told[k]) for k in UNSUPERVISED)], ", ".join(f"{k} double" for k in UNSUPERVISED)), supervision.KNOBS)).first().asDict()
        memory, join, part = plasticity.step(memory, nodes, edges, impact, m["risk"], knobs, anchors)
        for t in (memory.pairs, memory.nodes, memory.signals):
            if hasattr(t, "_path"):
                keep(t)
        setting = spark.createDataFrame([("plan", *[float(m[k]) for k in ("instability", "viscosity", "risk", "slowing", "hysteresis", "density", "noise", "coupling")])], "name string, instability double, viscosity double, risk double, slowing double, hysteresis double, density double, noise double, coupling double")
        ends = edges.select("edge_id", "ts", "layer", F.col("src").alias("u"), F.col("dst").alias("v"), "weight")
        plan = planning.best_plans(planning.plan_costs(ends, impact, own(setting, planning.PLANNER), most)).first()
        changed = saved(supervision.reweighted(ends, impact, m["risk"], m["instability"], m["viscosity"], plan.scale, keep=("edge_id", "ts", "layer")))
        counts = supervision.shifts(changed).first().asDict() | {"signed_shift": changed.agg(F.coalesce(F.avg("shift"), F.lit(0.0))).first()[0]}
        after = saved(changed.select("edge_id", "ts", F.col("u").alias("src"), F.col("v").alias("dst"), "layer", F.col("after").alias("weight")))
        both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))).alias("e")).select("e.*")
        pairs = lambda df: [(r.u, r.v) for r in df.collect()]
        new = merged(pairs(supervision.new_edges(impact, both, m["risk"], m["density"])), join)
        drop = merged(pairs(planning.drops(after.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight"), impact, m["risk"], m["density"])), part)
        budget = edits.allowed(plan.budget, m["risk"], m["density"], m["slowing"], knobs["budget"], most) if most > 0 else 0
        asked = max(0, min(round(plan.budget * knobs["drop_share"]), len(drop)))
        after, made = edits.applied(after, drop, new, budget, knobs["drop_bias"], knobs["new_bias"], asked)
        keep(after)
        terms = supervision.objective(own(spark.createDataFrame([(float(counts["mean_shift"] or 0.0), m["instability"], m["viscosity"], m["risk"], m["density"], m["noise"], m["coupling"], made.added + made.dropped)], "shift double, instability double, viscosity double, risk double, density double, noise double, coupling double, edits int"), planning.PLANNER)).first().asDict()
        report = m | knobs | {k: terms[k] for k in ("churn", "volatility", "rewiring", "risk_cost", "coupling_cost")} | counts
        report |= {"objective": terms["total"], "scale": plan.scale, "horizon": plan.horizon, "plan_budget": plan.budget, "added": made.added, "dropped": made.dropped, "blocked": made.blocked, "new": new, "drop": drop}
        report |= {"affinity_new": len(join), "affinity_drop": len(part), "tracked": memory.pairs.count(), "mean_budget": supervision.mean_budget(memory.nodes).first()[0]}
        return after, memory, report
