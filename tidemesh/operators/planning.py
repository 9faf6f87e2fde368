"""Scores that propose changes of a graph's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip(x: float) -> float:
    return max(0.0, min(1.0, x))


def drop_scores(pairs: DataFrame, impact: DataFrame, risk: float) -> DataFrame:
    """(u, v, weight, score): edges of low weight whose ends disagree score lowest and are dropped first.  A node without an impact
    has 0; the risk is held to 0..1."""
    at = lambda x: impact.select(F.col("node").alias(x), F.col("impact").alias("i_" + x))
    rows = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left")
    a, b = F.coalesce("i_u", F.lit(0.0)), F.coalesce("i_v", F.lit(0.0))
    risk = clip(risk)
    both = F.abs(a) + F.abs(b)
    gap = F.abs(a - b) / F.greatest(F.lit(1e-6), both)
    stable, match = F.greatest(F.lit(0.0), 1 - gap), F.when(a * b >= 0, 1.0).otherwise(0.0)
    support = (0.5 * both) / (1 + 0.5 * both) * (0.55 * stable + 0.45 * match)
    mismatch = (1 - match) * (0.5 + 0.5 * (1 - stable))
    score = F.col("weight") + (0.2 + 0.35 * risk) * support - (0.12 + 0.22 * risk) * mismatch - 0.08 * risk * gap
    return rows.select("u", "v", "weight", score.alias("score"))


def most_drops(risk: float, density: float) -> int:
    """Fewer at high risk, more in dense graphs."""
    return round(3 * (1 - 0.7 * clip(risk)) * (0.7 + 0.6 * clip(density)))


def drops(pairs: DataFrame, impact: DataFrame, risk: float, density: float) -> DataFrame:
    """The edges proposed for dropping, by their scores to nine decimals."""
    scored = drop_scores(pairs, impact, risk).withColumn("score", F.round("score", 9))
    return scored.orderBy("score", "u", "v").limit(most_drops(risk, density))


# Scales tried at high risk, in sparse graphs, in dense or noisy ones and else.
HIGH_RISK, SPARSE, NOISY, USUAL = (0.4, 0.55, 0.7, 0.85), (0.7, 1.0, 1.25, 1.5), (0.45, 0.65, 0.85, 1.0), (0.5, 0.8, 1.0, 1.2)
# What a planner weighs unless a profile has columns of these names: volatility and what noise adds, edits and
# what density adds, risk and what risk adds, adjusting too little or too much, from where on risk is high; scales tried.
PLANNER = {
    "volatility_weight": 0.28, "volatility_gain": 0.28, "rewiring_weight": 0.03, "rewiring_gain": 0.08, "risk_weight": 0.28, "risk_gain": 0.22, "under": 0.8, "over": 0.6, "high_risk": 0.75,
    "usual_scales": USUAL, "high_risk_scales": HIGH_RISK, "sparse_scales": SPARSE,
}
#: Settings that are tried in one job.
MOST_PROFILES = 10_000


def knobs(columns: list[str]):
    """The value of a planner's setting by its name: the column of that name, else the fixed value."""

    def knob(name: str):
        value = PLANNER[name]
        return F.col(name) if name in columns else F.array(*map(F.lit, value)) if isinstance(value, tuple) else F.lit(value)

    return knob


def _grid(most: int, knob):
    """(scales, budgets, horizon) of a profile, as columns."""
    risk, density, noise, slowing, hysteresis, coupling = map(F.col, ("risk", "density", "noise", "slowing", "hysteresis", "coupling"))
    numbers = lambda x: F.array(*map(F.lit, x))
    scales = F.when(risk > knob("high_risk"), knob("high_risk_scales")).when((density < 0.2) & (noise < 0.55), knob("sparse_scales")).when((density > 0.65) | (noise > 0.7), numbers(NOISY)).otherwise(knob("usual_scales"))
    wide, narrow = sorted({0, 1, min(most, 2), most}), sorted({0, 1, min(most, 2)})
    budgets = F.when((risk > 0.8) | (slowing > 0.75) | (hysteresis > 0.7), numbers([0, 1])).when(density < 0.2, numbers(wide)).otherwise(numbers(narrow)) if most > 0 else numbers([0])
    horizon = F.when((risk > knob("high_risk")) | (coupling > 0.8) | (slowing > 0.7), 5).when((density < 0.2) & (noise < 0.45), 4).when((noise > 0.75) | (hysteresis > 0.65), 5).when(density > 0.7, 3).otherwise(4)
    return scales, budgets, horizon


def plan_costs(edges: DataFrame, impact: DataFrame, profiles: DataFrame, most: int = 2) -> DataFrame:
    """(name, ord, scale, budget, horizon, shift, cost) of every plan of every profile.

    edges: (u, v, weight); profiles: name, instability, viscosity, risk, slowing, hysteresis, density, noise, coupling, and
    columns named as in PLANNER where a profile has a planner of its own.  The edges are read once, for the mean absolute shift at each scale of each profile; the steps ahead, each counting 0.72 of
    the one before, are a fold over that one number.  Without edges every plan costs 0."""
    if profiles.count() > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    knob = knobs(profiles.columns)
    scales, budgets, horizon = _grid(most, knob)
    grid = profiles.select("*", horizon.alias("horizon"), budgets.alias("budgets"), F.posexplode(scales).alias("k", "scale"))
    rows = edges.select("u", "v", F.col("weight").cast("double").alias("weight"))
    for x in "uv":
        rows = rows.join(impact.select(F.col("node").alias(x), F.col("impact").alias("i_" + x)), x, "left")
    a, b = F.coalesce("i_u", F.lit(0.0)), F.coalesce("i_v", F.lit(0.0))
    pressure = 0.65 * (a + b) / 2 + 0.35 * F.when(a * b >= 0, 1.0).otherwise(-1.0) * F.least(F.abs(a), F.abs(b))
    rows = rows.select("weight", pressure.alias("p"))
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk")))
    rate = 0.25 * (1 - 0.6 * risk) * F.col("scale")
    delta = rate * (0.22 * F.col("p") + 0.10 * F.col("instability") - 0.08 * F.col("viscosity") - 0.10 * risk) - F.when(F.abs("p") < 0.08, rate * 0.04).otherwise(0.0)
    moved = F.abs(F.greatest(F.lit(0.05), F.least(F.lit(5.0), F.col("weight") + delta)) - F.col("weight"))
    shifts = rows.crossJoin(F.broadcast(grid.select("name", "k", "scale", "risk", "instability", "viscosity"))).groupBy("name", "k").agg(F.avg(moved).alias("shift"))
    plans = grid.join(shifts, ["name", "k"], "left").select("*", F.posexplode("budgets").alias("j", "budget"))
    return plans.select("name", (F.col("k") * 100 + F.col("j")).alias("ord"), "scale", "budget", "horizon", "shift", F.when(F.col("shift").isNull(), 0.0).otherwise(_ahead(knob)).alias("cost"))


def _ahead(knob):
    """What a plan costs over its horizon, two steps at least."""
    shift, viscosity, slowing, hysteresis, noise, coupling, budget = map(F.col, ("shift", "viscosity", "slowing", "hysteresis", "noise", "coupling", "budget"))
    zero, unit = F.lit(0.0), lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    risk = unit(F.col("risk"))
    wanted = (0.06 + 0.1 * F.greatest(zero, F.col("instability") - 0.5 * viscosity) * (1 - 0.6 * risk)) * F.greatest(F.lit(0.5), 1 - 0.35 * slowing - 0.25 * hysteresis)
    penalty = knob("under") * F.greatest(zero, wanted - shift) + knob("over") * F.greatest(zero, shift - (0.24 - 0.12 * risk))
    fixed = (0.38 + 0.22 * unit(F.col("density"))) * shift + (0.2 + 0.2 * unit(noise)) * coupling + penalty
    answer = shift * F.greatest(F.lit(0.05), 1 - viscosity) * (1 - 0.45 * coupling)

    def step(s, _):
        volatile = F.greatest(zero, s["unrest"] - viscosity)
        edits = F.greatest(zero, F.bround(budget * s["share"]))
        cost = fixed + (knob("volatility_weight") + knob("volatility_gain") * unit(noise)) * volatile + (knob("rewiring_weight") + knob("rewiring_gain") * unit(F.col("density"))) * edits + (knob("risk_weight") + knob("risk_gain") * unit(s["risk"])) * s["risk"]
        return F.struct(
            F.greatest(zero, s["unrest"] - 0.28 * answer - 0.06 * volatile + 0.08 * s["risk"] * noise + 0.04 * slowing).alias("unrest"), F.greatest(zero, s["risk"] - 0.10 * answer + 0.05 * hysteresis).alias("risk"),
            (s["share"] * 0.72).alias("share"), (s["cost"] + s["share"] * cost).alias("cost"),
        )

    begin = F.struct(F.col("instability").cast("double").alias("unrest"), risk.cast("double").alias("risk"), F.lit(1.0).alias("share"), F.lit(0.0).alias("cost"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(2), F.col("horizon"))), begin, step, lambda s: s["cost"])


def best_plans(costs: DataFrame) -> DataFrame:
    """(name, scale, budget, horizon, shift, cost): the cheapest plan of each profile, of equal ones the first."""
    best = costs.groupBy("name").agg(F.min_by(F.struct("scale", "budget", "horizon", "shift", "cost"), F.struct("cost", "ord")).alias("b"))
    return best.select("name", "b.*")
