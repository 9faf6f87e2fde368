"""Choice of settings from many runs, gates that end a run, and the control of nodes by their cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import carried, number, own, upto
from .phase import unit
from .planning import PLANNER, best_plans, plan_costs
from .supervision import KNOBS

# What each mean adds to a setting's score; lower is better.
WEIGHTS = {"objective": 1.0, "critical": 0.55, "coupling": 0.3, "edits": 0.05, "confusion": 0.15, "forgetting": 0.12, "churn": 0.10, "retention": -0.18, "diversity": -0.15, "converged": -0.25}


# What the candidates of a calibration change of a planner and of the learning of affinities.
PLANNERS = {
    "base": {},
    "conservative": {"usual_scales": (0.4, 0.6, 0.8, 1.0), "risk_weight": 0.35, "risk_gain": 0.28},
    "explore_sparse": {"sparse_scales": (0.9, 1.15, 1.35, 1.6), "rewiring_weight": 0.02, "rewiring_gain": 0.05},
    "noise_robust": {"volatility_weight": 0.4, "volatility_gain": 0.34, "high_risk": 0.7},
    "risk_averse": {"high_risk": 0.65, "high_risk_scales": (0.35, 0.5, 0.65, 0.8), "under": 0.7, "over": 0.85},
}
LEARNERS = {
    "plastic_base": {},
    "plastic_fast": {"eta_up": 0.34, "eta_down": 0.08, "theta_on": 0.58, "theta_off": 0.36, "dwell": 2},
    "plastic_guarded": {"eta_up": 0.20, "eta_down": 0.16, "theta_on": 0.72, "theta_off": 0.28, "dwell": 3},
}


def candidates(spark: SparkSession, batch: str = "default") -> DataFrame:
    """(config, place, a column for each setting of `supervision.KNOBS` and `planning.PLANNER`): the planners (`default`, and
    for any name that is none), the learners (`plasticity`) or each planner with each learner (`mixed`)."""
    mode = batch.lower().strip()
    if mode == "mixed":
        chosen = [(f"{a}__{b}", a, b) for a in PLANNERS for b in LEARNERS]
    elif mode == "plasticity":
        chosen = [(b, "base", b) for b in LEARNERS]
    else:
        chosen = [(a, a, "plastic_base") for a in PLANNERS]
    kind = lambda v: "array<double>" if isinstance(v, tuple) else "int" if isinstance(v, int) else "double"
    usual = KNOBS | PLANNER
    rows = [(name, k, *[list(v) if isinstance(v, tuple) else v for v in (KNOBS | LEARNERS[b] | PLANNER | PLANNERS[a]).values()]) for k, (name, a, b) in enumerate(chosen)]
    return spark.createDataFrame(rows, "config string, place int, " + ", ".join(f"{c} {kind(v)}" for c, v in usual.items()))


def planned(edges: DataFrame, impact: DataFrame, profiles: DataFrame, settings: DataFrame, most: int = 2) -> DataFrame:
    """(config, name, scale, budget, horizon, shift, cost): the plan that each candidate's planner takes for each profile.
    Costs are held to nine decimals, so plans that cost the same are equal and the first is taken."""
    grid = profiles.crossJoin(F.broadcast(settings.select("config", *PLANNER)))  # as many rows as plan_costs allows
    grid = grid.withColumn("profile", F.col("name")).withColumn("name", F.to_json(F.struct("config", "profile")))
    costs = plan_costs(edges, impact, grid.drop("config", "profile"), most).withColumn("cost", F.round("cost", 9))
    best = best_plans(costs).withColumn("who", F.from_json("name", "config string, profile string"))
    return best.select("who.config", F.col("who.profile").alias("name"), "scale", "budget", "horizon", "shift", "cost")


def scores(runs: DataFrame, config: str) -> DataFrame:
    """One row a setting: the means of the measures in WEIGHTS over its runs, and their score.  A missing measure counts
    as 0 in its mean."""
    means = runs.groupBy(config).agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in WEIGHTS])
    return means.withColumn("score", sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)))


def best_window(scored: DataFrame, candidates: DataFrame, config: str, coefficients: list[str], fraction: float = 0.3) -> DataFrame:
    """One row: the number of settings in the best share, and of each coefficient (config, ...) its range among them.
    The share is held to 0.1..0.9 and has one setting at least; ties go to the smaller name.  Settings are few: a table
    of them, not of runs, is ranked."""
    k = max(1, round(scored.count() * max(0.1, min(0.9, fraction))))
    best = scored.orderBy("score", config).limit(k).select(config).join(candidates, config)
    ends = [f(c).alias(f"{name}_{c}") for c in coefficients for name, f in (("low", F.min), ("high", F.max))]
    return best.agg(F.count("*").alias("settings"), *ends)


def converged(steps: DataFrame, run: str, order: list[str], streak: int = 2, block: Column | None = None) -> DataFrame:
    """(run, ended): the first step, from 1, at which `streak` steps in a row were calm, null where there is none.

    A step (distance, before, after, shift, consistency, flat, still) is calm where its distance moved by less than
    0.015, the divergence fell to 0.8 of itself or 0.12, the mean shift is under 0.02, objective and distance have
    settled and the scales agree to 0.55.  The first step of a run is never calm; a missing measure isn't either.  Long
    runs are cut at `block`.
    """
    rows, w = carried(steps, [run], order, block, last=("distance",))
    fell = F.col("after") <= F.greatest(F.lit(0.12), 0.8 * F.col("before"))
    calm = (F.abs(F.col("distance") - F.lag("distance").over(w)) < 0.015) & fell & (F.abs("shift") < 0.02) & F.col("flat") & F.col("still") & (F.col("consistency") >= 0.55)
    rows = rows.select(run, *order, "_block", "_mark", number(w).alias("step_no"), F.coalesce(calm, F.lit(False)).alias("calm")).where("_mark = 1").drop("_mark")
    rows, w = carried(rows.withColumn("moved", F.when(~F.col("calm"), F.col("step_no"))), [run], order, F.col("_block"), maxima=("moved",))
    rows = own(rows.withColumn("since", F.coalesce(F.max("moved").over(upto(w)), F.lit(0))))
    return rows.groupBy(run).agg(F.min(F.when(F.col("step_no") - F.col("since") >= streak, F.col("step_no"))).cast("int").alias("ended"))


def projected(nodes: DataFrame, cluster: DataFrame, controls: DataFrame) -> DataFrame:
    """(node, impact): each node's impact with the control of its cluster (cluster, control) added, held to -5..5.  Nodes
    without a cluster, and clusters without a control, keep theirs."""
    rows = nodes.join(cluster.select("node", "cluster"), "node", "left").join(controls.select("cluster", "control"), "cluster", "left")
    moved = F.coalesce("impact", F.lit(0.0)) + F.coalesce("control", F.lit(0.0))
    return rows.select("node", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), moved)).alias("impact"))


def refinement(objectives: DataFrame, run: str) -> DataFrame:
    """(run, gain): mean of what the control of nodes improves on that of clusters, from (run, clusters, nodes); a step
    that gets worse counts as 0."""
    return objectives.groupBy(run).agg(F.avg(F.greatest(F.lit(0.0), F.col("clusters") - F.col("nodes"))).alias("gain"))


def affinity(score, second):
    """Weight of a mutual neighbour from its cosine and the second best of the node, both mapped to 0..1."""
    return 0.35 * F.greatest(F.lit(0.05), unit(score) - 0.65 * unit(second))


def mutual_neighbours(nearest: DataFrame) -> DataFrame:
    """(u, v, weight) from the nearest rows (query, item, score, rank) of every node, its scores being cosines: pairs where
    each is among the other's, with what both directions add.  A node with one neighbour has no second score: 0."""
    rows = nearest.select("query", "item", "rank", ((F.col("score") + 1) / 2).alias("score"))
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(Window.partitionBy("query"))
    rows = rows.withColumn("weight", affinity(F.col("score"), F.coalesce(second, F.lit(0.0))))
    back = rows.select(F.col("item").alias("query"), F.col("query").alias("item"))
    kept = rows.join(back, ["query", "item"], "left_semi")
    return kept.groupBy(F.least("query", "item").alias("u"), F.greatest("query", "item").alias("v")).agg(F.sum("weight").alias("weight"))
