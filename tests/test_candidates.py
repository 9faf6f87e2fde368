"""Candidates of a calibration, their planners and the reports."""

import random

import pytest

from test_edits import PROFILE, PROFILES
from tidemesh.operators import calibration, planning, supervision
from tidemesh.sources import sinks


def test_candidates(spark):
    one, two, both = (calibration.candidates(spark, b).orderBy("place").collect() for b in ("default", " Plasticity ", "mixed"))
    assert [r.config for r in one] == list(calibration.PLANNERS) and [r.config for r in two] == list(calibration.LEARNERS) and len(both) == 15
    assert [r.config for r in calibration.candidates(spark, "what").collect()] == [r.config for r in one]
    by = {r.config: r for r in both}
    r = by["risk_averse__plastic_guarded"]
    assert (r.high_risk, r.over, r.high_risk_scales, r.eta_up, r.dwell, r.volatility_weight) == (0.65, 0.85, [0.35, 0.5, 0.65, 0.8], 0.2, 3, 0.28)
    base = by["base__plastic_base"].asDict()
    assert all((tuple(base[k]) if isinstance(v, tuple) else base[k]) == v for k, v in (supervision.KNOBS | planning.PLANNER).items())


def test_planners_as_columns(spark, monkeypatch):
    """Each candidate's plans are those of a planner with its values fixed."""
    rng = random.Random(3)
    rows = [(*rng.sample("abcdef", 2), rng.uniform(0, 5)) for _ in range(30)]
    pairs = spark.createDataFrame(rows, "u string, v string, weight double")
    impact = spark.createDataFrame([(n, rng.uniform(-1, 1)) for n in "abcde"], "node string, impact double")
    profiles = spark.createDataFrame(PROFILES, PROFILE)
    settings = calibration.candidates(spark)
    got = {(r.config, r.name): (r.scale, r.budget, r.horizon, round(r.cost, 8)) for r in calibration.planned(pairs, impact, profiles, settings).collect()}
    assert len(got) == len(PROFILES) * len(calibration.PLANNERS)
    for config, changed in calibration.PLANNERS.items():
        with monkeypatch.context() as m:
            for name, value in changed.items():
                m.setitem(planning.PLANNER, name, value)
            for r in planning.best_plans(planning.plan_costs(pairs, impact, profiles)).collect():
                assert got[config, r.name] == (r.scale, r.budget, r.horizon, round(r.cost, 8))
    assert len({v for k, v in got.items() if k[1] == PROFILES[0][0]}) > 1  # candidates differ


def test_reports(spark, tmp_path):
    settings = calibration.candidates(spark, "default")
    runs = spark.createDataFrame([(c, k / 10 + s / 100) for k, c in enumerate(calibration.PLANNERS) for s in (0, 1)], "config string, objective double")
    for c in calibration.WEIGHTS:
        runs = runs if c == "objective" else runs.selectExpr("*", f"CAST(0 AS DOUBLE) AS {c}")
    scored = calibration.scores(runs, "config").join(settings.select("config", "place"), "config")
    rows = sinks.calibration_rows(scored)
    assert rows.columns[:4] == ["rank", "config_id", "score", "avg_adjustment_objective"] and len(rows.columns) == 16
    assert tuple(rows.collect()[1])[:5] == ("2", "conservative", "0.105000", "0.105000", "0.000000")
    summary = sinks.calibration_summary(scored, settings, "default")
    s = summary.first()
    assert len(s) == 17 and (s.batch, s.candidate_count, s.top_count) == ("default", 5, 2)
    assert (s.eta_up_min, s.eta_up_max, s.hysteresis_dwell_min, s.risk_weight_base_min, s.risk_weight_base_max) == (0.28, 0.28, 2, 0.28, 0.35)
    sinks.calibration_csv(rows, f"{tmp_path}/rows")
    sinks.calibration_csv(summary, f"{tmp_path}/summary")
    lines = next((tmp_path / "rows").glob("part-*.csv")).read_text().splitlines()
    assert len(lines) == 6 and lines[1].startswith("1,base,0.005000,0.005000,0.000000") and lines[0].endswith("avg_cluster_evicted_contexts")
    assert next((tmp_path / "summary").glob("part-*.csv")).read_text().splitlines()[1].startswith("default,5,2,0.280000,0.280000,0.100000")
    text = sinks.calibration_markdown(scored, summary, 0).splitlines()
    assert text[3] == "- Batch: `default` | Candidates: `5` | Top Window: `2`" and "`theta_on=0.620..0.620`" in text[4] and "`dwell=2..2`" in text[4]
    assert text[9].startswith("| 1 | `base` | 0.0050 | 0.0050 |") and text[10] == "" and text[9].endswith("| 0.00 | 0.00 |")
    # equal scores keep the order of the candidates, and nothing gives a row of zeros
    same = scored.withColumns({"score": calibration.F.lit(1.0)})
    assert [r.config_id for r in sinks.calibration_rows(same).collect()] == list(calibration.PLANNERS)
    none = sinks.calibration_summary(scored.limit(0), settings, "default").first()
    assert (none.candidate_count, none.top_count, none.eta_up_max, none.hysteresis_dwell_max) == (0, 0, 0.0, 0)
