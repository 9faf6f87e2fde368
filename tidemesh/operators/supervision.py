"""Supervision of a graph under a shock: confusion, forgetting, policies, reweighting, new edges and plasticity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .phase import unit
from .planning import clip, knobs
from .similarity import margin
from .topology import components

# Learning of affinities up and down, their thresholds, decay, use and recovery of budgets, steps to dwell.
ETA_UP, ETA_DOWN, THETA_ON, THETA_OFF, DECAY, USE, RECOVER, DWELL = 0.28, 0.10, 0.62, 0.34, 0.78, 0.20, 0.07, 2


def mixing_entropy(adjacency: DataFrame, cluster: DataFrame) -> DataFrame:
    """One row: how evenly neighbours lie over the clusters, 0 to 1, weighted by the simple degrees.
    adjacency: (node, nbr) both ways; cluster: (node, cluster)."""
    simple = adjacency.where("node <> nbr").select("node", "nbr").distinct()
    n = simple.join(cluster.select(F.col("node").alias("nbr"), "cluster"), "nbr", "left").groupBy("node", "cluster").agg(F.count("*").alias("n"))
    per = n.withColumn("d", F.sum("n").over(Window.partitionBy("node"))).withColumn("p", F.col("n") / F.col("d"))
    parts = per.agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-12) * F.col("d")).alias("e"), F.sum("n").alias("degrees"))
    sizes = cluster.agg(F.countDistinct("cluster").alias("clusters"))
    share = F.try_divide(F.col("e"), F.col("degrees") * F.log(F.col("clusters").cast("double")))
    return parts.join(F.broadcast(sizes)).select(F.when(F.col("clusters") <= 1, 0.0).otherwise(F.coalesce(unit(share), F.lit(0.0))).alias("mixing"))


def confusion(adjacency: DataFrame, cluster: DataFrame, impact: DataFrame) -> DataFrame:
    """One row (margin, mixing, confusion)."""
    values = cluster.join(impact, "node", "left").select("cluster", F.coalesce("impact", F.lit(0.0)).alias("value"))
    rows = margin(values).join(F.broadcast(mixing_entropy(adjacency, cluster)))
    return rows.select("margin", "mixing", unit(0.55 * (1 - F.col("margin")) + 0.45 * F.col("mixing")).alias("confusion"))


def important(nodes: DataFrame, impact: DataFrame, total: int, fraction: float = 0.2) -> DataFrame:
    """The top share of all nodes by absolute impact, ties by node; one node at least."""
    k = max(1, round(total * max(0.05, min(0.5, fraction))))
    return nodes.join(impact, "node", "left").orderBy(F.desc(F.abs(F.coalesce("impact", F.lit(0.0)))), "node").limit(k).select("node")


def forgetting(chosen: DataFrame, adjacency: DataFrame, baseline: float | None = None) -> DataFrame:
    """One row (loss, connectivity, forgetting): the share of chosen nodes without an edge, and the share that the largest
    component has of the graph among them."""
    own = chosen.select("node").distinct()
    held = own.join(adjacency.select("node").distinct(), "node", "left_semi")
    inner = adjacency.where("node <> nbr").join(own, "node", "left_semi").join(own.withColumnRenamed("node", "nbr"), "nbr", "left_semi").select("node", "nbr")
    largest = components(inner).groupBy("component").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("largest"))
    rows = own.agg(F.count("*").alias("n")).join(F.broadcast(held.agg(F.count("*").alias("held")))).join(F.broadcast(largest))
    loss = F.when(F.col("n") == 0, 0.0).otherwise(1 - F.col("held") / F.greatest(F.lit(1), F.col("n")))
    connectivity = F.when(F.col("n") <= 1, 1.0).otherwise(F.col("largest") / F.greatest(F.lit(1), F.col("n")))
    rows = rows.select(loss.alias("loss"), connectivity.alias("connectivity"))
    fallen = F.lit(0.0) if baseline is None else F.greatest(F.lit(0.0), F.lit(baseline) - F.col("connectivity"))
    return rows.withColumn("forgetting", unit(0.6 * F.col("loss") + 0.4 * fallen))


def phase_risk(critical: Column, warning: Column, broken: Column, flips: Column, coherence: Column) -> Column:
    return unit(0.48 * unit(critical) + 0.27 * unit(warning) + 0.13 * unit(broken) + 0.08 * unit(flips) + 0.04 * (1 - unit(coherence)))


def viscosity(regularity: Column, density: Column) -> Column:
    return unit(0.55 * regularity + 0.04 * density)


def instability(speed: Column, entropy: Column, regularity: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.7 * speed + 0.3 * entropy - 0.25 * regularity)


def coupling(residual: Column, divergence: Column, energy: Column) -> Column:
    up = lambda c: F.greatest(F.lit(0.0), c)
    return unit(0.45 * up(residual) + 0.3 * F.least(F.lit(1.0), up(divergence) / 2) + 0.25 * F.least(F.lit(1.0), up(energy) / 3))


def policy(rows: DataFrame) -> DataFrame:
    """`rows` with the knobs that confusion, forgetting, flip_rate and coherence lead to, from those of KNOBS or from columns
    of their names."""
    knob = lambda name: F.col(name) if name in rows.columns else F.lit(KNOBS[name])
    confused, forgot = unit(F.col("confusion")), unit(F.col("forgetting"))
    shaken = unit(0.7 * unit(F.col("flip_rate")) + 0.3 * (1 - unit(F.col("coherence"))))
    on = F.least(F.lit(0.95), knob("theta_on") + 0.2 * confused + 0.12 * shaken)
    off = F.greatest(F.lit(0.05), F.least(on - 0.05, knob("theta_off") + 0.12 * confused))
    new, drop = F.greatest(F.lit(0.3), 1 - 0.6 * confused - 0.25 * shaken), F.greatest(F.lit(0.2), 1 - 0.75 * forgot - 0.15 * shaken)
    return rows.withColumns({
        "shaken": shaken, "eta_up": F.greatest(F.lit(0.01), knob("eta_up") * (1 - 0.45 * confused) * (1 - 0.35 * shaken)), "eta_down": F.greatest(F.lit(0.01), knob("eta_down") * (1 + 0.6 * forgot)), "theta_on": on, "theta_off": off,
        "budget": F.greatest(F.lit(0.25), F.least(F.lit(1.25), (1 - 0.65 * confused) * (1 + 0.35 * forgot) * (1 - 0.4 * shaken))), "new_bias": new, "drop_bias": drop, "drop_share": unit(drop / (drop + new + 1e-9)),
        "dwell": knob("dwell") + F.when((confused > 0.65) | (shaken > 0.6), 1).otherwise(0),
    })


def objective(rows: DataFrame) -> DataFrame:
    """`rows` with the terms of the plan's cost, from shift, instability, viscosity, risk, density, noise, coupling and
    edits, and their total; lower is better.  Weights are those of a planner, or columns of their names."""
    knob = knobs(rows.columns)
    density, noise, risk = unit(F.col("density")), unit(F.col("noise")), F.col("risk")
    terms = {
        "churn": (0.38 + 0.22 * density) * F.col("shift"), "volatility": (knob("volatility_weight") + knob("volatility_gain") * noise) * F.greatest(F.lit(0.0), F.col("instability") - F.col("viscosity")),
        "rewiring": (knob("rewiring_weight") + knob("rewiring_gain") * density) * F.col("edits"), "risk_cost": (knob("risk_weight") + knob("risk_gain") * unit(risk)) * risk, "coupling_cost": (0.2 + 0.2 * noise) * F.col("coupling"),
    }
    return rows.withColumns(terms | {"total": sum(terms.values(), F.lit(0.0))})


def _ends(edges: DataFrame, impact: DataFrame) -> DataFrame:
    for x, y in (("u", "i_u"), ("v", "i_v")):
        edges = edges.join(impact.select(F.col("node").alias(x), F.col("impact").alias(y)), x, "left")
    return edges.fillna(0.0, ["i_u", "i_v"])


def reweighted(edges: DataFrame, impact: DataFrame, risk: float, instability: float, viscosity: float, scale: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, weight, after, change, shift, and the columns to keep): edges between nodes of strong impact of one sign gain, all others lose; weights
    stay in 0.05..5.  change is 1, -1 or 0."""
    rate = 0.25 * (1 - 0.6 * clip(risk)) * scale
    a, b = F.col("i_u"), F.col("i_v")
    pressure = 0.65 * (a + b) / 2 + 0.35 * F.when(a * b >= 0, 1.0).otherwise(-1.0) * F.least(F.abs(a), F.abs(b))
    rows = _ends(edges.select("u", "v", F.col("weight").cast("double").alias("weight"), *keep), impact).withColumn("pressure", pressure)
    delta = rate * (0.22 * F.col("pressure") + 0.10 * instability - 0.08 * viscosity - 0.10 * clip(risk)) - F.when(F.abs("pressure") < 0.08, rate * 0.04).otherwise(0.0)
    after = F.greatest(F.lit(0.05), F.least(F.lit(5.0), F.col("weight") + delta))
    rows = rows.withColumn("after", after).withColumn("shift", F.col("after") - F.col("weight"))
    change = F.when(F.col("shift") > 1e-6, 1).when(F.col("shift") < -1e-6, -1).otherwise(0)
    return rows.select("u", "v", "weight", F.round("after", 6).alias("after"), change.alias("change"), "shift", *keep)


def shifts(changed: DataFrame) -> DataFrame:
    """One row: edges that gained, lost and stayed, and the mean absolute shift; nothing is written."""
    return changed.agg(F.count_if(F.col("change") > 0).alias("gained"), F.count_if(F.col("change") < 0).alias("lost"), F.count_if(F.col("change") == 0).alias("same"), F.avg(F.abs("shift")).alias("mean_shift"))


def new_edges(impact: DataFrame, adjacency: DataFrame, risk: float, density: float, most: int = 3, anchors: int = 12) -> DataFrame:
    """(u, v, score): pairs of the `anchors` nodes of largest impact that are no neighbours, by the cosine of (impact,
    degree, mean impact of neighbours), the share of neighbours they do not share, and at high risk how near their
    impacts are.  The anchors are a top-k, so nothing here grows but one aggregation over the adjacency."""
    risk, density = clip(risk), clip(density)
    top = impact.orderBy(F.desc(F.abs("impact")), "node").limit(anchors)
    simple = adjacency.select("node", "nbr").distinct()
    at = impact.select(F.col("node").alias("nbr"), F.col("impact").alias("i"))
    near = simple.join(F.broadcast(top.select("node")), "node").join(at, "nbr", "left").groupBy("node").agg(F.count("*").alias("d"), F.sum(F.coalesce("i", F.lit(0.0))).alias("s"))
    vectors = top.join(near, "node", "left").fillna(0, ["d", "s"]).withColumn("mean", F.col("s") / F.greatest(F.lit(1), F.col("d")))
    # twelve nodes make sixty-six pairs
    a, b = (vectors.select(F.lit(1).alias("all"), F.col("node").alias(x), F.col("impact").alias("i_" + x), F.col("d").alias("d_" + x), F.col("mean").alias("m_" + x)) for x in "uv")
    pairs = a.join(b, "all").where("u < v").join(simple.select(F.col("node").alias("u"), F.col("nbr").alias("v")), ["u", "v"], "left_anti")
    mine = simple.join(F.broadcast(top.select("node")), "node")
    common = mine.select(F.col("node").alias("u"), "nbr").join(mine.select(F.col("node").alias("v"), "nbr"), "nbr").where("u < v").groupBy("u", "v").agg(F.count("*").alias("common"))
    rows = pairs.join(common, ["u", "v"], "left").fillna(0, ["common"])
    size = lambda x: F.sqrt(F.pow("i_" + x, 2) + F.pow("d_" + x, 2) + F.pow("m_" + x, 2))
    both = size("u") * size("v")
    cosine = F.when(both <= 1e-9, 0.0).otherwise(F.try_divide(F.col("i_u") * F.col("i_v") + F.col("d_u") * F.col("d_v") + F.col("m_u") * F.col("m_v"), both))
    union = F.col("d_u") + F.col("d_v") - F.col("common")
    bridge = F.when(union == 0, 0.0).otherwise(1 - F.try_divide(F.col("common"), union))
    stable = unit(1 - F.abs(F.col("i_u") - F.col("i_v")) / F.greatest(F.lit(1e-6), F.abs("i_u") + F.abs("i_v")))
    score = (1 - risk) * (0.55 * cosine + 0.45 * bridge) + risk * (0.7 * cosine + 0.3 * stable)
    limit = max(0, round(most * (1 - 0.75 * risk) * (1 + 0.4 * (1 - density))))
    return rows.select("u", "v", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "u", "v").limit(limit)


def merged(first: DataFrame, more: DataFrame, most: int = 6) -> DataFrame:
    """(u, v): suggestions (u, v, ord) of two lists in their order, each pair once whatever its direction."""
    rows = first.select("u", "v", F.struct(F.lit(0).alias("k"), "ord").alias("at")).unionByName(more.select("u", "v", F.struct(F.lit(1).alias("k"), "ord").alias("at")))
    once = rows.groupBy(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).agg(F.min(F.struct("at", "u", "v")).alias("m"))
    return once.orderBy("m.at").limit(most).select("m.u", "m.v")


def recovered(budgets: DataFrame) -> DataFrame:
    """Node budgets (node, budget) after a rest."""
    return budgets.withColumn("budget", F.col("budget") + RECOVER * (1 - F.col("budget")))


#: What `policy` sets, as it is without confusion, forgetting and unrest.
KNOBS = {"eta_up": ETA_UP, "eta_down": ETA_DOWN, "theta_on": THETA_ON, "theta_off": THETA_OFF, "dwell": DWELL}


def plasticity(pairs: DataFrame, signals: DataFrame, budgets: DataFrame, risk: float = 0.0, knobs: dict[str, float] = KNOBS) -> tuple[DataFrame, DataFrame]:
    """(pairs, budgets) after a step.  pairs: u, v, affinity, eligibility, on, off; signals: node, now, before; a node
    without a budget has 1.  What a pair gains is paid by both of its nodes."""
    top = signals.agg(F.greatest(F.max(F.abs("now")), F.lit(0.0)).alias("top")).select(F.when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("top"))
    rows = pairs
    for x in "uv":
        rows = rows.join(signals.select(F.col("node").alias(x), F.col("now").alias("n_" + x), F.col("before").alias("p_" + x)), x, "left").join(budgets.select(F.col("node").alias(x), F.col("budget").alias("b_" + x)), x, "left")
        rows = rows.fillna(0.0, ["n_" + x, "p_" + x]).fillna(1.0, ["b_" + x])
    rows = rows.join(F.broadcast(top))
    n, p = ({x: F.col(f"{k}_{x}") / F.col("top") for x in "uv"} for k in "np")
    one = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    drive = 0.7 * one(n["u"] * n["v"]) + 0.3 * one(p["u"] * n["v"] - p["v"] * n["u"])
    rows = rows.withColumn("e", DECAY * F.col("eligibility") + (1 - DECAY) * drive)
    up = knobs["eta_up"] * F.greatest(F.lit(0.0), F.col("e")) * F.col("b_u") * F.col("b_v") * (1 - 0.5 * clip(risk))
    rows = rows.withColumn("a", unit(F.col("affinity") + up - knobs["eta_down"] * F.greatest(F.lit(0.0), -F.col("e"))))
    high, low = F.col("a") >= knobs["theta_on"], F.col("a") <= knobs["theta_off"]
    after = rows.select("u", "v", F.col("a").alias("affinity"), one(F.col("e")).alias("eligibility"), F.when(high, F.col("on") + 1).otherwise(0).alias("on"), F.when(low & ~high, F.col("off") + 1).otherwise(0).alias("off"))
    used = rows.select(F.explode(F.array("u", "v")).alias("node"), (USE * F.greatest(F.lit(0.0), F.col("a") - F.col("affinity"))).alias("use")).groupBy("node").agg(F.sum("use").alias("use"))
    left = budgets.join(used, "node", "full_outer").select("node", unit(F.coalesce("budget", F.lit(1.0)) - F.coalesce("use", F.lit(0.0))).alias("budget"))
    return after, left


def trimmed(pairs: DataFrame, most: int = 24_000) -> DataFrame:
    """The pairs of highest affinity; their number is the feature."""
    return pairs.orderBy(F.desc("affinity"), "u", "v").limit(most)


def mean_budget(budgets: DataFrame) -> DataFrame:
    return budgets.agg(F.coalesce(F.avg("budget"), F.lit(1.0)).alias("budget"))


def seeds(targets: DataFrame, intensity: float) -> DataFrame:
    """(node, impact) from (target, weight): the weight is any text; one that is no number, or missing, is 1."""
    weight = F.coalesce(F.expr("try_cast(weight as double)"), F.lit(1.0))
    return targets.groupBy(F.col("target").alias("node")).agg(F.max(weight * intensity).alias("impact"))


#: What a shock of size 1 adds to each feature.
FACTORS = {"social_entropy": 0.10, "temporal_regularity": -0.12, "spatial_range": 0.05, "schedule_density": 0.18, "network_centrality": 0.08, "transition_speed": 0.22}


def shock(intensity: Column, weight: Column) -> list[Column]:
    """The six features' push by a shock of an intensity, held to 0..2, and a mean target weight, held to -1..1."""
    signed = F.greatest(F.lit(0.0), F.least(F.lit(2.0), intensity)) * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(weight, F.lit(1.0))))
    return [(f * signed).alias(name) for name, f in FACTORS.items()]


def polarity(edges: DataFrame) -> DataFrame:
    """(u, v, polarity): of the edges (ord, src, dst, polarity) of an unordered pair the last one's sign, 1 for none."""
    last = F.max_by(F.coalesce("polarity", F.lit(1)), "ord")
    return edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.when(last < 0, -1).otherwise(1).alias("polarity"))


def node_control(rows: DataFrame, risk: float, speed: float) -> DataFrame:
    """(node, control, controlled) from div, phi, cycle, higher, curl, harmonic and impact of each node."""
    limit = max(0.35, 1 - 0.35 * clip(risk))
    u = -0.35 * F.col("div") - 0.15 * F.col("phi") - 0.2 * (speed - 0.45) - 0.12 * F.col("cycle") - 0.1 * F.col("higher") - 0.18 * F.col("curl") - 0.16 * F.col("harmonic")
    u = F.round(F.greatest(F.lit(-limit), F.least(F.lit(limit), u)), 6)
    return rows.select("node", u.alias("control"), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("impact") + u)).alias("controlled"), (F.abs(u) >= 0.98 * limit).alias("saturated"))


def control_cost(controls: DataFrame) -> DataFrame:
    """One row: energy and share of saturated nodes."""
    return controls.agg(F.sum(F.col("control") * F.col("control")).alias("energy"), F.avg(F.col("saturated").cast("double")).alias("saturation"))


def recall(predicted: DataFrame, expected: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """(method, recall, precision): mean over all scenarios, four decimals.  predicted: method, scenario, node (repeats
    count again); expected: scenario, node.  A scenario for which a method predicts nothing counts 0 and 0 for it; methods
    (method) that predict nothing at all are only known if they are given."""
    sizes = expected.groupBy("scenario").agg(F.countDistinct("node").alias("n"))
    scenarios = sizes.select("scenario").unionByName(predicted.select("scenario")).distinct()
    names = (predicted.select("method") if methods is None else predicted.select("method").unionByName(methods.select("method"))).distinct()
    hit = predicted.join(expected.select("scenario", "node", F.lit(1).alias("hit")).distinct(), ["scenario", "node"], "left")
    per = hit.groupBy("method", "scenario").agg(F.count("hit").alias("hits"), F.count("*").alias("given"))
    # methods are a handful, so each meets each scenario
    rows = scenarios.crossJoin(F.broadcast(names)).join(sizes, "scenario", "left").join(per, ["method", "scenario"], "left").fillna(0, ["n", "hits", "given"])
    share = lambda c: F.round(F.avg(F.col("hits") / F.greatest(F.lit(1), F.col(c))), 4)
    return rows.groupBy("method").agg(share("n").alias("recall"), share("given").alias("precision"))
