"""An adjustment as a whole, and cycles of it."""

import datetime

import pytest
from tidemesh.operators import adjust, plasticity

T = datetime.datetime(2024, 1, 1)
ROWS = [("a", "b", 1.0), ("b", "c", 0.4), ("a", "c", 0.8), ("c", "d", 0.6), ("d", "e", 0.5), ("e", "f", 0.3), ("d", "f", 0.7)]
STATE = {"temporal_regularity": 0.3, "schedule_density": 4.0, "transition_speed": 0.9, "social_entropy": 0.7}


def graph(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    return nodes, spark.createDataFrame([(f"e{k}", T + datetime.timedelta(hours=k), a, b, "social", w) for k, (a, b, w) in enumerate(ROWS)], "edge_id string, ts timestamp, src string, dst string, layer string, weight double")


def shock(spark, values):
    return spark.createDataFrame(list(zip("abcdef", values)), "node string, impact double")


def test_adjustment(spark):
    nodes, edges = graph(spark)
    impact = shock(spark, [1.0, 0.8, 0.5, -0.4, 0.2, 0.0])
    after, memory, r = adjust.adjust(nodes, edges, impact, STATE, plasticity.fresh(spark), anchors=4)
    assert r["gained"] + r["lost"] + r["same"] == len(ROWS) and (r["risk"], r["coupling"], r["budget"]) == (0.0, 0.0, 1.0)
    assert abs(r["viscosity"] - (0.55 * 0.3 + 0.16)) < 1e-12 and abs(r["instability"] - (0.63 + 0.21 - 0.075)) < 1e-12 and abs(r["density"] - 7 / 15) < 1e-12
    kept = {x.edge_id: x for x in after.collect()}
    assert len(kept) == len(ROWS) + r["added"] - r["dropped"] and all(0.05 <= x.weight <= 5 for x in kept.values())
    # every weight moves as its pressure says
    at = dict(zip("abcdef", [1.0, 0.8, 0.5, -0.4, 0.2, 0.0]))
    for k, (a, b, w) in enumerate(ROWS):
        x, y = at[a], at[b]
        p = 0.325 * (x + y) + 0.35 * (1 if x * y >= 0 else -1) * min(abs(x), abs(y))
        move = 0.25 * r["scale"] * (0.22 * p + 0.1 * r["instability"] - 0.08 * r["viscosity"] - (0.04 if abs(p) < 0.08 else 0))
        if f"e{k}" in kept:
            assert kept[f"e{k}"].weight == pytest.approx(max(0.05, min(5, w + move)), abs=1e-6)
    assert r["tracked"] == memory.pairs.count() == len({tuple(sorted(e[:2])) for e in ROWS} | {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")})
    # the state after the edits is whole: no node without an edge
    assert {n for x in kept.values() for n in (x.src, x.dst)} == set("abcdef")


def test_risk_and_confusion_hold_back(spark):
    nodes, edges = graph(spark)
    impact = shock(spark, [1.0, 0.8, 0.5, -0.4, 0.2, 0.0])
    _, _, calm = adjust.adjust(nodes, edges, impact, STATE, plasticity.fresh(spark), most=0, anchors=4)
    _, _, tense = adjust.adjust(nodes, edges, impact, STATE, plasticity.fresh(spark), {"critical": 1.0, "warning": 1.0, "slowing": 1.0, "hysteresis": 1.0}, {"residual_ratio": 1.0, "energy": 5.0}, {"confusion": 1.0, "forgetting": 0.5}, most=0, anchors=4)
    assert tense["mean_shift"] < calm["mean_shift"] and tense["horizon"] == 5 and calm["horizon"] <= 5 and tense["objective"] > calm["objective"]
    assert tense["eta_up"] < calm["eta_up"] and tense["theta_on"] > calm["theta_on"] and tense["dwell"] == calm["dwell"] + 1
    assert (calm["added"], calm["dropped"], tense["added"], tense["dropped"]) == (0, 0, 0, 0) and calm["plan_budget"] == 0


def test_nothing_to_adjust(spark):
    nodes, edges = graph(spark)
    after, memory, r = adjust.adjust(nodes, edges.limit(0), shock(spark, [1.0]), {}, plasticity.fresh(spark), anchors=3)
    assert (r["gained"], r["lost"], r["same"], r["signed_shift"], r["plan_budget"]) == (0, 0, 0, 0.0, 0) and after.count() == r["added"]
    assert adjust.profile(nodes.limit(0), edges.limit(0), shock(spark, [1.0]).limit(0)) == {"density": 0.0, "noise": 0.0}
    assert adjust.merged([("b", "a")], [("a", "b"), ("c", "d")]) == [("a", "b"), ("c", "d")]


def test_intervention_and_prediction(spark):
    from tidemesh.operators import cycles

    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    edges = graph(spark)[1].where("src < 'd' and dst <= 'd'")
    p = cycles.Perturbation("p1", ("a",), 1.2, {"a": "0.5"})
    answer, base, other = cycles.intervene(nodes, edges, p, cycles=1)
    m = answer["metrics"]
    assert (answer["query_type"], answer["evidence"], answer["uncertainty"], answer["blocked"], len(answer["claims"])) == ("intervene", ["perturbation:p1"], 0.4, False, 4)
    for name, done in (("baseline", base), ("intervention", other)):
        assert len(done.rows) == m[f"{name}_cycles_executed"] == 1 and m[f"{name}_converged"] == 0 and m[f"{name}_affected_actants"] == 4 and {f"{name}_{k}" for k in cycles.MEANS} <= set(m)
        assert all(0 <= m[f"{name}_{k}"] <= 1 for k in ("critical_transition_score", "early_warning_score", "cross_scale_consistency", "supervisory_confusion_score", "supervisory_forgetting_score", "graph_density", "saturation_ratio", "path_efficiency", "basin_occupancy"))
        assert done.edges.count() == 4 + sum(r["added"] - r["dropped"] for r in done.rows) and done.carry.fine.objective == done.rows[-1]["objective"]
    # the second run begins with the gains, affinities and contexts of the first, on the same graph
    assert (base.carry.step, other.carry.step) == (1, 2) and base.carry.fine != other.carry.fine and m["baseline_graph_density"] == m["intervention_graph_density"]
    assert m["delta_objective_score"] == pytest.approx(m["intervention_objective_score"] - m["baseline_objective_score"]) and m["hysteresis_index"] == pytest.approx(abs(base.rows[0]["distance"] - other.rows[0]["distance"]))
    told = cycles.predicted(base, p)
    assert (told["query_type"], told["uncertainty"], len(told["claims"])) == ("predict", 0.35, 8) and told["metrics"] == {k.removeprefix("baseline_"): v for k, v in m.items() if k.startswith("baseline_")}
    assert cycles._answer("predict", ["My motivation"], ["e"], {"x": 1.0}, 0.3) == {"query_type": "predict", "claims": [], "evidence": ["e"], "metrics": {"x": 1.0}, "uncertainty": 1.0, "blocked": True, "reason": "motivation"}


def test_counter_shock_and_gate():
    from tidemesh.operators import cycles

    p = cycles.Perturbation("p", ("a", "b"), 5.0, {"a": "x", "b": "0"})
    assert cycles.shocked(p, False)["transition_speed"] == pytest.approx(0.22 * 2 * 0.5) and cycles.shocked(p, True)["transition_speed"] == pytest.approx(-0.7 * 0.22)
    row = {"distance": 1.0, "objective": 2.0, "div_before": 1.0, "div_after": 0.5, "signed_shift": 0.0, "consistency": 0.6}
    assert not cycles.calm([row] * 2) and cycles.calm([row] * 3)
    for key, bad in (("distance", 1.1), ("objective", 2.1), ("div_after", 0.9), ("signed_shift", 0.1), ("consistency", 0.5)):
        assert not cycles.calm([row, row, row | {key: bad}])
    assert cycles.stabilised(1.0, 3) and cycles.stabilised(0.02, 1) and not cycles.stabilised(1.0, 1)
