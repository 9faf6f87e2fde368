"""Settings, gates, projection and mutual neighbours against plain Python and by hand."""

from tidemesh.operators import calibration


def test_scores_and_window(spark):
    names = list(calibration.WEIGHTS)
    rows = [(c, *[float(c * k % 7) if k else None for k in range(len(names))]) for c in range(1, 11) for _ in range(3)]
    runs = spark.createDataFrame(rows, "config int, " + ", ".join(f"{c} double" for c in names))
    want = {c: sum(w * (c * k % 7 if k else 0) for k, w in enumerate(calibration.WEIGHTS.values())) for c in range(1, 11)}
    scored = calibration.scores(runs, "config")
    assert all(abs(r.score - want[r.config]) < 1e-9 for r in scored.collect())
    candidates = scored.selectExpr("config", "config * 1.5D AS gain")
    best = sorted(want, key=lambda c: (round(want[c], 9), c))
    for fraction, n in ((0.3, 3), (5.0, 9), (0.0, 1)):
        r = calibration.best_window(scored, candidates, "config", ["gain"], fraction).first()
        assert r.settings == n and (n > 1 or r.low_gain == r.high_gain == best[0] * 1.5)
    assert calibration.best_window(scored.limit(0), candidates, "config", ["gain"]).first().settings == 0


def test_two_calm_steps_end_a_run(spark):
    schema = "run string, i int, distance double, before double, after double, shift double, consistency double, flat boolean, still boolean"
    calm = (1.0, 0.1, 0.05, 0.0, 0.6, True, True)
    rows = [("calm", i, *calm) for i in range(4)] + [("torn", i, *calm[:5], i != 2, True) for i in range(4)] + [("one", 0, *calm)] + [("null", i, *calm[:3], None, *calm[4:]) for i in range(3)]
    got = {r.run: r.ended for r in calibration.converged(spark.createDataFrame(rows, schema), "run", ["i"]).collect()}
    assert got == {"calm": 3, "torn": None, "one": None, "null": None}


def test_projection_and_gain(spark):
    nodes = spark.createDataFrame([("a", 4.5), ("b", None), ("c", 1.0)], "node string, impact double")
    cluster = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, cluster int")
    controls = spark.createDataFrame([(1, 0.75)], "cluster int, control double")
    assert {r.node: r.impact for r in calibration.projected(nodes, cluster, controls).collect()} == {"a": 5.0, "b": 0.75, "c": 1.0}
    rows = spark.createDataFrame([("r", 2.0, 1.0), ("r", 1.0, 3.0)], "run string, clusters double, nodes double")
    assert calibration.refinement(rows, "run").first().gain == 0.5


def test_neighbours_are_mutual(spark):
    near = [("a", "b", 1.0, 1), ("a", "c", 0.0, 2), ("b", "a", 1.0, 1), ("c", "b", 0.5, 1)]
    got = calibration.mutual_neighbours(spark.createDataFrame(near, "query string, item string, score double, rank int")).collect()
    # a gives 1 - 0.65 * 0.5, b has no second neighbour and gives 1
    assert [(r.u, r.v) for r in got] == [("a", "b")] and abs(got[0].weight - 0.35 * (0.675 + 1)) < 1e-12
