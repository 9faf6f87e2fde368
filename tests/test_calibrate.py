"""A calibration as a whole: its order, what is carried on, its means; and real cycles with a candidate's settings."""

import datetime

import pytest
from tidemesh.operators import adjust, calibrate, calibration, cycles, planning, plasticity, supervision
from tidemesh.sources import sinks

T = datetime.datetime(2024, 1, 1)
EDGES = "edge_id string, ts timestamp, src string, dst string, layer string, weight double"


def graph(spark, names="abcd"):
    ends = [(names[k], names[(k + 1) % len(names)], 0.5 + 0.2 * k) for k in range(len(names))]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    return nodes, spark.createDataFrame([(f"e{k}", T + datetime.timedelta(hours=k), a, b, "social", w) for k, (a, b, w) in enumerate(ends)], EDGES)


def made(seen):
    """A stand-in of `cycles.run` that notes what it is asked and gives measures that grow from call to call."""

    def run(nodes, edges, p, n_cycles=3, counter=False, carry=None, polarity=None, settings=None, graph="graph"):
        k = len(seen) + 1
        seen.append((p.name, graph, edges, carry, settings["eta_up"], n_cycles))
        row = {"adjustment": k, "coupling": 0.1 * k, "added": 1.0, "dropped": 0.5 * (k % 2), "confusion": 0.2, "forgetting": 0.3 * k, "consistency": 0.25 * k, "active_contexts": k, "evicted_contexts": 0}
        return cycles.Run(f"edges{k}", None, [row, row], k % 3 == 1, f"carry{k}", f"{graph}:adjusted")

    return run


def test_order_carry_and_means(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cycles, "run", made(seen))
    monkeypatch.setattr(cycles, "phases", lambda rows: {"critical": 0.4})
    both = [calibrate.Scenario(n, f"nodes-{n}", f"edges-{n}", cycles.Perturbation(n, ("a",))) for n in ("s1", "s2")]
    settings = calibration.candidates(spark, "plasticity").where("config <> 'plastic_guarded'")
    got = {(r.config, r.scenario): r for r in calibrate.runs(spark, settings, both, steps=2, n_cycles=4).collect()}
    assert [x[:2] for x in seen] == [("s1", "s1"), ("s1", "s1"), ("s1", "s1:adjusted"), ("s2", "s2"), ("s2", "s2"), ("s2", "s2:adjusted")] * 2
    # the first further run is on the scenario's own graph, the next on what that left; nothing passes from candidate to candidate
    assert [x[2] for x in seen[:6]] == ["edges-s1", "edges-s1", "edges2", "edges-s2", "edges-s2", "edges5"]
    assert [x[3] for x in seen] == [None, "carry1", "carry2", "carry3", "carry4", "carry5", None, "carry7", "carry8", "carry9", "carry10", "carry11"]
    assert [x[4] for x in seen] == [0.28] * 6 + [0.34] * 6 and {x[5] for x in seen} == {4}
    r = got["plastic_base", "s1"]
    assert (r.objective, r.coupling, r.edits, r.converged, r.critical, r.confusion) == pytest.approx((1, 0.1, 1.5, 1, 0.4, 0.2))
    assert (r.churn, r.retention, r.diversity, r.active_contexts) == pytest.approx(((1 + 1.5) / 2, (0.4 + 0.1) / 2, (0.5 + 0.75) / 2, 1))
    r = got["plastic_base", "s2"]  # shares are held to 0..1
    assert (r.objective, r.retention, r.diversity) == pytest.approx((4, 0, 1))
    # means, scores and reports
    scored = calibrate.scored(calibrate.runs(spark, settings, both, steps=2), settings).orderBy("place").collect()
    seen.clear()
    again = calibrate.scored(calibrate.runs(spark, settings, both, steps=2), settings)
    one = again.where("config = 'plastic_base'").first()
    assert [x.config for x in scored] == ["plastic_base", "plastic_fast"] and one.objective == pytest.approx(2.5) and one.converged == pytest.approx(1.0)
    assert one.score == pytest.approx(sum(w * one[c] for c, w in calibration.WEIGHTS.items()))
    assert calibrate.runs(spark, settings, []).count() == calibrate.runs(spark, settings.limit(0), both).count() == 0
    seen.clear()
    done, summary = calibrate.calibrate(spark, both, "plasticity", 0.3, steps=1)
    s, rows = summary.first(), sinks.calibration_rows(done).collect()
    assert (s.batch, s.candidate_count, s.top_count, s.eta_up_min) == ("plasticity", 3, 1, 0.28) and [r.config_id for r in rows] == ["plastic_base", "plastic_fast", "plastic_guarded"]


def test_scenarios_of_tables(spark):
    nodes, edges = graph(spark)
    tagged = lambda df: df.selectExpr("'s1' AS scenario", "*").unionByName(df.selectExpr("'s2' AS scenario", "*").limit(2))
    a, b, c = calibrate.scenarios(tagged(nodes), tagged(edges), [cycles.Perturbation(n, ("a",)) for n in ("s1", "s2", "s3")])
    assert (a.nodes.count(), b.nodes.count(), c.nodes.count(), a.edges.columns) == (4, 2, 0, edges.columns) and b.name == "s2"


def test_settings_of_an_adjustment(spark, monkeypatch):
    """A candidate's settings act as its fixed values would."""
    nodes, edges = graph(spark)
    impact = spark.createDataFrame(list(zip("abcd", [1.0, 0.8, -0.4, 0.2])), "node string, impact double")
    state = {"temporal_regularity": 0.3, "schedule_density": 1.0, "transition_speed": 0.9, "social_entropy": 0.7}
    told = (state, plasticity.fresh(spark), {"critical": 0.8}, {"residual_ratio": 0.5, "energy": 1.0}, {"confusion": 0.4})
    chosen = {r.config: r.asDict() for r in calibration.candidates(spark, "mixed").collect()}["risk_averse__plastic_fast"]
    of = lambda **more: adjust.adjust(nodes, edges, impact, *told, most=0, anchors=3, **more)[2]
    asked, usual = of(settings=chosen), of()
    for part in (planning.PLANNER, supervision.KNOBS):
        for k in part:
            monkeypatch.setitem(part, k, tuple(chosen[k]) if isinstance(chosen[k], list) else chosen[k])
    fixed = of()
    assert {k: v for k, v in asked.items() if isinstance(v, float)} == pytest.approx({k: v for k, v in fixed.items() if isinstance(v, float)})
    assert asked["eta_up"] > usual["eta_up"] and asked["theta_on"] < usual["theta_on"] and asked["scale"] in chosen["usual_scales"] + chosen["high_risk_scales"] + chosen["sparse_scales"] + list(planning.NOISY)


def test_cycles_of_a_candidate(spark):
    nodes, edges = graph(spark, "abc")
    s = calibrate.Scenario("s1", nodes, edges, cycles.Perturbation("s1", ("a",), 1.2))
    settings = calibration.candidates(spark, "plasticity").where("config = 'plastic_fast'")
    r = calibrate.runs(spark, settings, [s], steps=1, n_cycles=1).first()
    assert (r.config, r.scenario, r.converged) == ("plastic_fast", "s1", 0.0) and r.churn >= 0 and r.edits >= 0
    assert all(0 <= r[c] <= 1 for c in ("critical", "coupling", "confusion", "forgetting", "retention", "diversity")) and r.active_contexts == 1
