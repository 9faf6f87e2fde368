"""Prediction and intervention: cycles of spread, dynamics, coarse and fine control, phases, supervision and adjustment.

A cycle reads and writes tables; between cycles the driver keeps one row of numbers for each.  Nodes are (node), edges
(edge_id, ts, src, dst, layer, weight); `polarity` (u, v, polarity) may say which pairs turn a sign.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved, scratch
from . import calibration, communities, dynamics, gains, memory, phase, plasticity, propagation, retrieval, series, similarity, supervision, topology
from .adjust import adjust

#: Neighbours by features that a node may be clustered with; comparing all nodes costs the square of their number.
NEIGHBOURS = 4
# What a counter-shock is of a shock, uncertainty of a prediction and of an intervention.
COUNTER, PREDICTED, INTERVENED = -0.7, 0.35, 0.4


@dataclass(frozen=True)
class Perturbation:
    name: str
    targets: tuple[str, ...]
    intensity: float = 1.0
    weights: dict[str, str] = field(default_factory=dict)
    #: Clusters of cycles with one stream are remembered together.
    stream: str = ""


@dataclass
class Carry:
    """What one run leaves to the next: gains, affinities, and the clusters and worth of contexts."""

    fine: gains.Gains
    coarse: gains.Gains
    affinities: plasticity.Memory
    contexts: DataFrame
    clusters: dict[str, DataFrame] = field(default_factory=dict)
    step: int = 0


@dataclass
class Run:
    edges: DataFrame
    impact: DataFrame
    #: One dict a cycle.
    rows: list[dict]
    converged: bool
    carry: Carry
    #: The name of the graph that the last cycle left.
    graph: str = "graph"


def fresh(nodes: DataFrame) -> Carry:
    spark = nodes.sparkSession
    return Carry(gains.Gains(), gains.COARSE_GAINS, plasticity.fresh(spark, dict(nodes.dtypes)["node"]), memory.fresh(spark))


def default_perturbation(nodes: DataFrame) -> Perturbation:
    first = nodes.agg(F.min("node")).first()[0]
    return Perturbation("auto-default", () if first is None else (first,))


def signed(edges: DataFrame, polarity: DataFrame | None) -> DataFrame:
    """(node, nbr, polarity) of distinct neighbours, both ways."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    pairs = pairs.withColumn("polarity", F.lit(1)) if polarity is None else pairs.join(polarity, ["u", "v"], "left").fillna(1, ["polarity"])
    return pairs.select("polarity", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("node"), F.col("u").alias("nbr")))).alias("e")).select("e.*", "polarity")


def spread(nodes: DataFrame, edges: DataFrame, p: Perturbation, polarity: DataFrame | None) -> tuple[DataFrame, bool]:
    """((node, impact), stabilised) after three hops.  Targets that are no nodes reach nobody."""
    spark = nodes.sparkSession
    kind = dict(nodes.dtypes)["node"]
    seeds = supervision.seeds(spark.createDataFrame([(t, p.weights.get(t)) for t in p.targets], f"target {kind}, weight string"), p.intensity).join(nodes, "node", "left_semi")
    strength = seeds.agg(F.coalesce(F.max(F.abs("impact")), F.lit(float(p.intensity)))).first()[0]
    impact = propagation.spread(seeds, signed(edges, polarity), strength)
    hops = impact.agg(F.coalesce(F.max("hop"), F.lit(0))).first()[0]
    return impact.select("node", "impact"), stabilised(strength, hops)


def stabilised(strength: float, hops: int) -> bool:
    """Whether a spread ended by its hops or its floor; one that found no more nodes did not settle."""
    return hops >= propagation.HOPS or strength * propagation.KEEP**hops <= propagation.FLOOR


def features(nodes: DataFrame, edges: DataFrame, asked: list) -> list[dict[str, float]]:
    """The six features of a few nodes, in their order; zeros for one without edges."""
    ends = edges.select(F.explode(F.array_distinct(F.array(F.struct(F.col("src").alias("entity"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("entity"), F.col("src").alias("nbr"))))).alias("e"), "layer").select("e.*", "layer").where(F.col("entity").isin(asked) if asked else F.lit(False))
    found = {r.entity: {f: float(r[f]) for f in dynamics.FEATURES} for r in propagation.state_vectors(ends, nodes.select("node").distinct().agg(F.count("*"))).collect()}
    return [found.get(a, dict.fromkeys(dynamics.FEATURES, 0.0)) for a in asked]


def shocked(p: Perturbation, counter: bool) -> dict[str, float]:
    """The push on the six features."""
    weights = []
    for t in p.targets:
        try:
            weights.append(float(p.weights.get(t, 1.0)))
        except (TypeError, ValueError):
            weights.append(1.0)
    mean = sum(weights) / len(weights) if weights else 1.0
    size = max(0.0, min(2.0, p.intensity)) * max(-1.0, min(1.0, mean)) * (COUNTER if counter else 1.0)
    return {name: f * size for name, f in supervision.FACTORS.items()}


def clustered(nodes: DataFrame, edges: DataFrame, impact: DataFrame, before: DataFrame | None, neighbours: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """((node, cluster), hybrid pairs): communities of weights, neighbours by features and earlier clusters."""
    with scratch(nodes.sparkSession) as keep:
        pairs = saved(edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("weight").alias("weight")))
        more = []
        n = nodes.count()
        if neighbours and n > 1:
            top = impact.agg(F.max(F.abs("impact"))).first()[0] or 1.0
            own = topology.node_features(pairs, impact).select("node", *[F.col(c) for c in ("degree", "clustering", "around")])
            rows = nodes.select("node").join(impact, "node", "left").join(own, "node", "left").fillna(0.0)
            vectors = saved(rows.select("node", F.array(F.col("impact") / F.lit(top), "degree", "clustering", "around").alias("vector")))
            near = similarity.cosine_topk(vectors, vectors, "node", "vector", max(1, min(neighbours, n - 1)), 8, 8)
            more.append(calibration.mutual_neighbours(near))
        earlier = nodes.limit(0).select("node", F.col("node").alias("cluster")) if before is None else before
        hybrid = saved(topology.hybrid_edges(pairs, earlier, impact, *more))
        return keep(saved(communities.communities(nodes.select("node"), hybrid))), keep(hybrid)


def signed_value() -> Column:
    """Of what `topology.cluster_impact` gives: direction by the sum, size by how far the values agree."""
    direction = F.when(F.abs("total") > 1e-12, F.signum("total")).otherwise(F.when(F.col("largest") >= 0, 1.0).otherwise(-1.0))
    return F.when(F.col("absolute") <= 1e-12, 0.0).otherwise(direction * F.col("absolute") / F.col("n") * (0.3 + 0.7 * F.abs("total") / F.col("absolute")))


def coarse(nodes: DataFrame, edges: DataFrame, impact: DataFrame, state: dict[str, float], risk: float, g: gains.Gains, before: DataFrame | None) -> tuple[DataFrame, DataFrame, dict, gains.Gains]:
    """((node, cluster), (node, impact), measures, gains) after the control of clusters; the measures have objective and
    consistency."""
    with scratch(nodes.sparkSession) as keep:
        cluster, hybrid = clustered(nodes, edges, impact, before)
        own = cluster.join(impact, "node", "left").select("cluster", F.coalesce("impact", F.lit(0.0)).alias("value"))
        values = saved(topology.cluster_impact(own).select(F.col("cluster").alias("node"), signed_value().alias("impact")))
        between = saved(communities.cluster_edges(hybrid, cluster))
        if between.isEmpty():  # one cluster
            controls, m = values.select("node", F.lit(0.0).alias("control")), {"objective": 0.0}
        else:
            terms, m = gains.node_terms(values.select("node"), between, values, values.agg(F.min("node")).first()[0])
            controls, m, g = gains.control(terms, m, g, state.get("transition_speed", 0.0), risk, gains.COARSE)
        moved = calibration.projected(nodes.select("node").join(impact, "node", "left"), cluster, controls.withColumnRenamed("node", "cluster"))
        moved = keep(saved(moved))
        agree = similarity.cross_scale(cluster.join(moved, "node").select("cluster", F.col("impact").alias("value")))
        x = agree.agg(F.sum(F.col("score") * F.col("n")).alias("s"), F.sum("n").alias("n")).first()
        return keep(cluster), moved, m | {"consistency": x.s / x.n if x.n else 0.0}, g


def phases(rows: list[dict]) -> dict:
    """The phase of the cycles so far."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    data = [("run", k, float(r["speed"]), float(r["distance"]), float(r["tension"]), float(r["objective"])) for k, r in enumerate(rows)]
    return phase.analysis(spark.createDataFrame(data, "run string, i int, speed double, dist double, tension double, objective double"), "run", ["i"]).first().asDict()


def calm(rows: list[dict]) -> bool:
    """Whether the last cycle was one after which the run may end: the distance, the divergence, the weights and the last
    three objectives have settled, and the scales agree."""
    if len(rows) < 3:
        return False
    last, before = rows[-1], rows[-2]
    flat = all(abs(rows[-k]["objective"] - rows[-k - 1]["objective"]) <= 0.01 for k in (1, 2))
    return abs(last["distance"] - before["distance"]) < 0.015 and last["div_after"] <= max(0.12, 0.8 * last["div_before"]) and abs(last["signed_shift"]) < 0.02 and flat and last["consistency"] >= 0.55


def run(nodes: DataFrame, edges: DataFrame, p: Perturbation, cycles: int = 3, counter: bool = False, carry: Carry | None = None, polarity: DataFrame | None = None, settings: dict | None = None, graph: str = "graph") -> Run:
    """Cycles over a graph, each on the edges that the one before left; ended early after two calm ones in a row.  `settings`
    are those of `adjust`; clusters are remembered by the stream, or by the graph's name."""
    carry = replace(carry) if carry else fresh(nodes)
    carry.clusters = dict(carry.clusters)
    shock, rows, streak, converged, told = shocked(p, counter), [], 0, False, {}
    important = baseline = None
    nodes = saved(nodes.select("node").distinct())
    edges = saved(edges.select("edge_id", "ts", "src", "dst", "layer", F.col("weight").cast("double").alias("weight")))
    for _ in range(max(1, cycles)):
        impact, settled = spread(nodes, edges, p, polarity)
        impact = saved(impact)
        target = p.targets[0] if p.targets else nodes.agg(F.min("node")).first()[0]
        ranked = [r.node for r in impact.where(F.col("node") != target).orderBy(F.desc(F.abs("impact")), "node").limit(2).collect()] if target is not None else []
        states = features(nodes, edges, [target, *ranked] if target is not None else [])
        vector = lambda s: [s[f] for f in dynamics.FEATURES]
        one = nodes.sparkSession.createDataFrame([(vector(states[0]) if states else None, [vector(s) for s in states] or None, vector(shock))], "state array<double>, history array<array<double>>, shock array<double>")
        end = dynamics.simulate(one).first().snapshots[-1]
        state = dict(zip(dynamics.FEATURES, end.state))
        risk = told.get("critical", 0.0)
        context = p.stream.strip() or graph
        cluster, moved, rough, carry.coarse = coarse(nodes, edges, impact, state, risk, carry.coarse, carry.clusters.get(context))
        carry.step += 1
        carry.clusters[context] = cluster
        seen = cluster.agg(F.countDistinct("cluster").cast("int").alias("clusters")).join(F.broadcast(impact.agg(F.avg(F.abs("impact")).alias("impact")))).select(F.lit("run").alias("owner"), F.lit(context).alias("context"), "clusters", "impact")
        carry.contexts, owners = memory.remembered(carry.contexts, seen, carry.step)
        held = owners.first()
        ordered = edges.select(F.struct("ts", "edge_id").alias("ord"), "src", "dst", "weight")
        first = nodes.agg(F.min("node")).first()[0]
        terms, m = gains.node_terms(nodes, ordered, moved, first)
        controls, m, carry.fine = gains.control(terms, m, carry.fine, state["transition_speed"], risk)
        controlled = saved(controls.select("node", F.col("controlled").alias("impact")))
        row = {"speed": state["transition_speed"], "distance": end.distance, "tension": m["tension"], "objective": m["objective"]}
        told = phases([*rows, row])
        both = signed(edges, None).select("node", "nbr")
        structural = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight")
        confused = supervision.confusion(both, communities.communities(nodes, structural), controlled).first()
        important = important if important is not None else saved(supervision.important(nodes, controlled, nodes.count()))
        lost = supervision.forgetting(important, both, baseline).first()
        baseline = lost.connectivity if baseline is None else baseline
        edges, carry.affinities, report = adjust(nodes, edges, controlled, state, carry.affinities, told, m, {"confusion": confused.confusion, "forgetting": lost.forgetting, "flip_rate": told["flip_rate"], "coherence": told["coherence"]}, settings=settings)
        report["adjustment"] = report.pop("objective")
        rows.append(report | m | row | {
            "state": state, "settled": settled, "rough_objective": rough["objective"], "consistency": rough["consistency"], "refinement": max(0.0, rough["objective"] - m["objective"]), "confusion": confused.confusion, "forgetting": lost.forgetting,
            "reduction": max(0.0, m["div_before"] - m["div_after"]), "active_contexts": held.active if held else 0, "evicted_contexts": held.evicted if held else 0, "risk": report["risk"], "reached": impact.count(), "new_count": len(report["new"]), "drop_count": len(report["drop"]),
        })
        graph += ":adjusted"
        streak = streak + 1 if calm(rows) else 0
        if streak >= 2:
            converged = True
            break
    return Run(edges, impact, rows, converged, carry, graph)


#: What is averaged over the cycles.
MEANS = {
    "mean_weight_shift": "signed_shift", "adjustment_objective_score": "adjustment", "adjustment_scale": "scale", "planner_horizon": "horizon", "edit_budget": "plan_budget", "graph_density": "density", "impact_noise": "noise", "coupling_penalty": "coupling",
    "adjustment_term_churn": "churn", "adjustment_term_volatility": "volatility", "adjustment_term_rewiring": "rewiring", "adjustment_term_risk": "risk_cost", "adjustment_term_coupling": "coupling_cost", "applied_new_edges": "added", "applied_drop_edges": "dropped",
    "blocked_drop_edges": "blocked", "suggested_new_edges": "new_count", "suggested_drop_edges": "drop_count", "control_energy": "energy", "residual_ratio": "residual_ratio", "divergence_reduction": "reduction", "saturation_ratio": "saturation", "cycle_pressure": "cycle_mean",
    "objective_score": "objective", "curl_ratio": "curl_ratio", "harmonic_ratio": "harmonic_ratio", "higher_order_pressure": "higher_mean", "simplex_density": "simplex_density", "topological_tension": "tension", "cluster_objective": "rough_objective",
    "cross_scale_consistency": "consistency", "micro_refinement_gain": "refinement", "cluster_active_contexts": "active_contexts", "cluster_evicted_contexts": "evicted_contexts", "supervisory_confusion_score": "confusion", "supervisory_forgetting_score": "forgetting",
}


def means(rows: list[dict]) -> dict[str, float]:
    """What MEANS names, averaged over the cycles; 0 where a cycle has none."""
    return {name: float(sum(float(r.get(key) or 0.0) for r in rows) / len(rows)) for name, key in MEANS.items()}


def trajectory(rows: list[dict], shock: dict[str, float]) -> tuple[dict[str, float], list[str]]:
    """(measures, state classes) of the path that the cycles' states take."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    data = [("run", k, r["distance"], *r["state"].values()) for k, r in enumerate(rows)]
    names = list(dynamics.FEATURES)
    states = spark.createDataFrame(data, "run string, i int, distance double, " + ", ".join(f"{n} double" for n in names))
    label = series.state_class(F.col("temporal_regularity"), F.col("transition_speed"), F.col("schedule_density"))
    states = states.withColumns({"label": label, "speed": F.col("transition_speed"), "regularity": F.col("temporal_regularity"), "density": F.col("schedule_density")})
    steps = series.transitions(states, "run", ["i"]).agg(F.coalesce(F.max(F.col("n") / F.col("total")), F.lit(0.0))).first()[0]
    turns = series.triggers(states, "run", ["i"]).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.round("confidence", 3)), F.lit(0.0)).alias("c")).first()
    around = series.basin(states, "run", ["i"], names).first()
    main = series.dominant(states, "run", ["i"]).first().label
    aligned = series.alignment(states, "run", ["i"], shock).first().aligned
    lasting = series.resilience(states, "run", ["i"], "distance")
    back, x = series.recovery(lasting, "run").first(), lasting.first()
    turned = series.flips(states, "run", ["i"], "distance", 0.0).first()
    out = {
        "dominant_transition_prob": steps, "transition_trigger_count": float(turns.n), "avg_trigger_confidence": turns.c, "attractor_basin_radius": around.radius, "basin_occupancy": around.occupancy, "causal_alignment_score": aligned, "recovery_rate": back.rate,
        "overshoot_index": x.overshoot, "settling_time": float(x.settling), "path_efficiency": back.efficiency, "oscillation_index": 0.0 if len(rows) < 3 else turned.flips / max(1, len(rows) - 2),
    }
    labels = [r.label for r in states.orderBy("i").collect()]  # as many as cycles
    return out | {"state_class_count": float(len(set(labels)))}, [*labels, main]


def metrics(done: Run, shock: dict[str, float]) -> tuple[dict[str, float], dict]:
    """(metrics, texts) of a run."""
    rows, last = done.rows, phases(done.rows)
    path, labels = trajectory(rows, shock)
    still = len(rows) > 1 and abs(rows[-1]["distance"] - rows[-2]["distance"]) < 0.02
    out = means(rows) | path | {
        "affected_actants": float(rows[-1]["reached"]), "stabilized": float(still), "dynamics_stabilized": float(still), "dynamics_steps": float(len(rows)), "final_attractor_distance": rows[-1]["distance"], "strengthened_edges": float(sum(r["gained"] for r in rows)),
        "weakened_edges": float(sum(r["lost"] for r in rows)), "converged": float(done.converged), "cycles_executed": float(len(rows)), "objective_improvement": rows[0]["objective"] - rows[-1]["objective"], "critical_transition_score": last["critical"],
        "early_warning_score": last["warning"], "regime_switch_count": float(last["switches"]), "regime_persistence_score": last["persistence"], "coherence_break_score": last["broken"], "critical_slowing_score": last["slowing"],
        "hysteresis_proxy_score": last["hysteresis"], "sign_flip_rate": last["flip_rate"], "polarity_coherence_score": last["coherence"],
    }
    return out, {"states": labels[:-1], "basin": labels[-1], "regime": last["regime"]}


def _answer(kind: str, claims: list[str], evidence: list[str], found: dict[str, float], uncertainty: float) -> dict:
    """An answer after the guardrail: a blocked one keeps its evidence and metrics."""
    from pyspark.sql import SparkSession

    reason = SparkSession.getActiveSession().createDataFrame([(" ".join(claims),)], "t string").select(retrieval.blocked_by(F.col("t"))).first()[0]
    return {"query_type": kind, "claims": [] if reason else claims, "evidence": evidence, "metrics": found, "uncertainty": 1.0 if reason else uncertainty, "blocked": reason is not None, "reason": reason}


def predict(nodes: DataFrame, edges: DataFrame, p: Perturbation | None = None, cycles: int = 3, polarity: DataFrame | None = None) -> tuple[dict, Run]:
    """(answer, run): what a shock leads to."""
    p = p or default_perturbation(nodes)
    done = run(nodes, edges, p, cycles, polarity=polarity)
    return predicted(done, p), done


def predicted(done: Run, p: Perturbation) -> dict:
    """The answer that a run gives."""
    found, texts = metrics(done, shocked(p, False))
    top = [r.node for r in done.impact.orderBy(F.desc("impact"), "node").limit(3).collect()]
    claims = [
        f"{int(found['affected_actants'])} nodes are reached; the most: {', '.join(map(str, top)) or 'none'}.", f"{len(done.rows)} states, at last {found['final_attractor_distance']:.4f} from the attractor.",
        f"State classes: {', '.join(texts['states'])}; mostly {texts['basin']}; {int(found['transition_trigger_count'])} triggers.", f"Edges +{int(found['strengthened_edges'])}/-{int(found['weakened_edges'])}, mean shift {found['mean_weight_shift']:.4f}.",
        f"Adjustment costs {found['adjustment_objective_score']:.4f} at scale {found['adjustment_scale']:.3f}.", f"Edits {found['applied_new_edges']:.2f} new, {found['applied_drop_edges']:.2f} dropped.", f"Control energy {found['control_energy']:.4f}, residual {found['residual_ratio']:.4f}.",
        f"Phase {texts['regime']}, critical score {found['critical_transition_score']:.3f}.",
    ]
    return _answer("predict", claims, [f"perturbation:{p.name}"], found, PREDICTED)


def intervene(nodes: DataFrame, edges: DataFrame, p: Perturbation | None = None, cycles: int = 3, polarity: DataFrame | None = None) -> tuple[dict, Run, Run]:
    """(answer, baseline, intervention): the shock, and then the counter-shock from the same graph with what the first run
    learned; metrics have both, and what the second adds."""
    p = p or default_perturbation(nodes)
    base = run(nodes, edges, p, cycles, polarity=polarity)
    other = run(nodes, edges, p, cycles, counter=True, carry=base.carry, polarity=polarity)
    links = propagation.rewires(spread(nodes, edges, p, polarity)[0], signed(edges, None)).collect()
    (a, _), (b, texts) = metrics(base, shocked(p, False)), metrics(other, shocked(p, True))
    n = min(len(base.rows), len(other.rows))
    found = {f"baseline_{k}": v for k, v in a.items()} | {f"intervention_{k}": v for k, v in b.items()} | {f"delta_{k}": b[k] - a[k] for k in a}
    found |= {"hysteresis_index": sum(abs(base.rows[k]["distance"] - other.rows[k]["distance"]) for k in range(n)) / n, "rewired_edges": float(len(links))}
    claims = [
        f"The intervention ends {b['final_attractor_distance']:.4f} from the attractor, the baseline {a['final_attractor_distance']:.4f}.", f"Links that suggest themselves: {', '.join(f'{r.node}-{r.nbr}' for r in links) or 'none'}.",
        f"Mostly {texts['basin']}, phase {texts['regime']}.", f"Hysteresis {found['hysteresis_index']:.4f}.",
    ]
    return _answer("intervene", claims, [f"perturbation:{p.name}"], found, INTERVENED), base, other
