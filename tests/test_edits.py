"""Structural edits, plan search, predictors and recall against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from tidemesh.operators import edits, planning, prediction, supervision

T = datetime.datetime(2024, 1, 1)
SCHEMA = "edge_id string, ts timestamp, src string, dst string, layer string, weight double"


def edges(spark, rows):
    return spark.createDataFrame([(f"e{k}", T + datetime.timedelta(hours=k), a, b, "social", float(w)) for k, (a, b, w) in enumerate(rows)], SCHEMA)


def test_budgets():
    assert edits.allowed(2, 0, 1, 0) == 2 and edits.allowed(2, 0, 0.5, 0) == 2 and edits.allowed(2, 1, 0, 0) == 0 and edits.allowed(1, 0, 1, 0) == 1
    assert edits.allowed(2, 0, 0, 1) == round(2 * 0.8 * 0.5) and edits.allowed(9, 0, 1, 0, multiplier=9) == round(2 * 1.2 * 1.25)
    assert edits.shared(1, 5, 5) == (0, 1) and edits.shared(2, 5, 5) == (1, 1) and edits.shared(2, 0, 1) == (0, 1) and edits.shared(3, 5, 5, drop_bias=0.0) == (0, 3)


def test_drops_keep_the_graph_whole(spark):
    # two triangles on a bridge, a leaf, a double edge and a loop
    g = edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1), ("f", "g", 1), ("a", "b", 0.5), ("e", "e", 1)])
    after, dropped, blocked = edits.drop(g, [("d", "c"), ("f", "g"), ("b", "a"), ("e", "e"), ("x", "y"), ("a", "b"), ("b", "c")])
    # the bridge and the leaf's edge stay; of the double edge the weaker goes, then the other, which makes b - c the last of b
    assert (dropped, blocked) == (3, 3) and {r.edge_id for r in after.collect()} == {f"e{k}" for k in (1, 2, 3, 4, 5, 6, 7)}


def count(nodes, pairs):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        label[root(a)] = root(b)
    return len({root(n) for n in nodes})


def test_no_edit_splits_a_component(spark):
    rng = random.Random(2)
    rows = [(*rng.sample("abcdefgh", 2), rng.choice([0.5, 1.0, 2.0])) for _ in range(11)]
    asked = [(a, b) for a, b, _ in rng.sample(rows, 4)]
    left, want = [(f"e{k}", a, b, w) for k, (a, b, w) in enumerate(rows)], 0
    nodes = {n for _, a, b, _ in left for n in (a, b)}
    for u, v in asked:
        mine = [e for e in left if {e[1], e[2]} == {u, v}]
        if mine:
            rest = [e for e in left if e != min(mine, key=lambda e: (e[3], int(e[0][1:])))]
            whole = all(any(n in e[1:3] for e in rest) for n in (u, v)) and count(nodes, [e[1:3] for e in rest]) <= count(nodes, [e[1:3] for e in left])
            left, want = (rest, want) if whole else (left, want + 1)
    after, dropped, blocked = edits.drop(edges(spark, rows), asked)
    assert {r.edge_id for r in after.collect()} == {e[0] for e in left} and blocked == want and dropped == len(rows) - len(left)


def test_edits_within_a_budget(spark):
    g = edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1)])
    after, made = edits.applied(g, [("a", "b"), ("b", "c")], [("d", "a"), ("b", "d")], 2, asked_drops=2)
    # a - b goes, d - a comes; then b - c is the last edge of b, and a - b is gone
    assert made == edits.Edits(1, 1, 1)
    new = after.where("layer = 'adaptive'").first()
    assert (new.edge_id, new.src, new.dst, new.weight, new.ts) == ("auto_add_3_0", "d", "a", 0.07, T + datetime.timedelta(hours=3, seconds=1))
    same, made = edits.applied(g, [], [("a", "a"), ("b", "a")], 2)
    assert made == edits.Edits(0, 0, 0) and same.count() == 4
    empty, made = edits.applied(edges(spark, [("a", "b", 1)]).limit(0), [("a", "b")], [("a", "b")], 3)
    assert made == edits.Edits(1, 0, 1) and empty.first().edge_id == "auto_add_0_0"


PROFILE = "name string, instability double, viscosity double, risk double, slowing double, hysteresis double, density double, noise double, coupling double"
PROFILES = [("usual", 0.6, 0.2, 0.3, 0.2, 0.1, 0.4, 0.5, 0.2), ("risky", 1.0, 0.1, 0.9, 0.8, 0.8, 0.1, 0.9, 0.9), ("sparse", 0.2, 0.5, 0.0, 0.0, 0.0, 0.1, 0.2, 0.0), ("dense", 0.9, 0.0, 0.5, 0.1, 0.2, 0.8, 0.6, 0.4), ("still", 0.0, 1.0, 0.0, 0.0, 0.0, 0.5, 0.8, 1.0)]


def plain_plan(rows, impact, p, most=2):
    _, inst, visc, risk, slow, hyst, dens, noise, coup = p
    scales = planning.HIGH_RISK if risk > 0.75 else planning.SPARSE if dens < 0.2 and noise < 0.55 else planning.NOISY if dens > 0.65 or noise > 0.7 else planning.USUAL
    budgets = [0, 1] if risk > 0.8 or slow > 0.75 or hyst > 0.7 else [0, 1, 2]
    horizon = 5 if risk > 0.75 or coup > 0.8 or slow > 0.7 else 4 if dens < 0.2 and noise < 0.45 else 5 if noise > 0.75 or hyst > 0.65 else 3 if dens > 0.7 else 4
    best = None
    for scale in scales:
        moves = []
        for a, b, w in rows:
            x, y = impact.get(a, 0.0), impact.get(b, 0.0)
            q = 0.325 * (x + y) + 0.35 * (1 if x * y >= 0 else -1) * min(abs(x), abs(y))
            rate = 0.25 * (1 - 0.6 * risk) * scale
            moves.append(abs(max(0.05, min(5, w + rate * (0.22 * q + 0.1 * inst - 0.08 * visc - 0.1 * risk - (0.04 if abs(q) < 0.08 else 0)))) - w))
        m = sum(moves) / len(moves)
        wanted = (0.06 + 0.1 * max(0, inst - 0.5 * visc) * (1 - 0.6 * risk)) * max(0.5, 1 - 0.35 * slow - 0.25 * hyst)
        for budget in budgets:
            total, share, i, r = 0.0, 1.0, inst, risk
            for _ in range(horizon):
                vol = max(0, i - visc)
                cost = (0.38 + 0.22 * dens) * m + (0.28 + 0.28 * noise) * vol + (0.03 + 0.08 * dens) * round(budget * share) + (0.28 + 0.22 * min(1, r)) * r + (0.2 + 0.2 * noise) * coup
                total += share * (cost + 0.8 * max(0, wanted - m) + 0.6 * max(0, m - (0.24 - 0.12 * risk)))
                answer = m * max(0.05, 1 - visc) * (1 - 0.45 * coup)
                i, r, share = max(0, i - 0.28 * answer - 0.06 * vol + 0.08 * r * noise + 0.04 * slow), max(0, r - 0.1 * answer + 0.05 * hyst), share * 0.72
            if best is None or total < best[-1] - 1e-15:
                best = (scale, budget, horizon, total)
    return best


def test_plans(spark):
    rng = random.Random(6)
    rows = [(*rng.sample("abcdef", 2), rng.uniform(0, 5)) for _ in range(30)]
    impact = {n: rng.uniform(-1, 1) for n in "abcde"}
    pairs, at = spark.createDataFrame(rows, "u string, v string, weight double"), spark.createDataFrame(list(impact.items()), "node string, impact double")
    got = {r.name: r for r in planning.best_plans(planning.plan_costs(pairs, at, spark.createDataFrame(PROFILES, PROFILE))).collect()}
    for p in PROFILES:
        scale, budget, horizon, cost = plain_plan(rows, impact, p)
        r = got[p[0]]
        assert (r.scale, r.budget, r.horizon) == (scale, budget, horizon) and abs(r.cost - cost) < 1e-9
    # without edges all plans cost nothing and the first one is taken
    none = planning.best_plans(planning.plan_costs(pairs.limit(0), at, spark.createDataFrame(PROFILES, PROFILE))).collect()
    assert {(r.name, r.scale, r.budget, r.cost) for r in none} == {("usual", 0.5, 0, 0.0), ("risky", 0.4, 0, 0.0), ("sparse", 0.7, 0, 0.0), ("dense", 0.45, 0, 0.0), ("still", 0.45, 0, 0.0)}
    assert planning.plan_costs(pairs, at, spark.createDataFrame(PROFILES[:1], PROFILE), most=0).select("budget").distinct().collect() == [(0,)]


def test_recall_counts_scenarios_without_a_prediction(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "scenario int, node string")
    given = spark.createDataFrame([("x", 1, "a"), ("x", 1, "a"), ("x", 1, "z"), ("x", 2, "c"), ("y", 4, "a")], "method string, scenario int, node string")
    got = {r.method: (r.recall, r.precision) for r in supervision.recall(given, expected, spark.createDataFrame([("none",)], "method string")).collect()}
    assert got == {"x": (0.5, round((2 / 3 + 1) / 4, 4)), "y": (0.0, 0.0), "none": (0.0, 0.0)}


def test_predictors(spark):
    rows = [(0, "n1", "n2", "social", 1.0), (1, "n3", "n1", "predict", 1.0), (2, "n1", "n2", "x", 1.0), (3, "n4", "n4", "x", 1.0), (4, "n2", "n5", "x", 1.0)]
    g = spark.createDataFrame(rows, "ord int, src string, dst string, layer string, weight double")
    asked = spark.createDataFrame([(1, "n1"), (2, "n4"), (3, "gone")], "scenario int, target string")
    names = lambda df: {s: [r.node for r in sorted(df.collect(), key=lambda r: r.rank) if r.scenario == s] for s in (1, 2, 3)}
    assert names(prediction.plain(asked, g, 4)) == {1: ["n1", "n2", "n3", "n2"], 2: ["n4", "n4"], 3: ["gone"]}
    assert names(prediction.lexical(asked, g)) == {1: ["n3", "n1", "n2"], 2: ["n3", "n1", "n4"], 3: ["n3", "n1"]}
    both = g.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))).alias("e")).select("e.*", F.lit(1).alias("polarity"))
    assert names(prediction.flow(asked, both)) == {1: ["n1", "n2", "n3"], 2: ["n4"], 3: ["gone"]}
    assert names(prediction.truth(asked, both, 2))[1] == ["n1", "n2"]


@pytest.mark.parametrize("k", [1, 3])
def test_spread_of_many_is_that_of_one(spark, k):
    from tidemesh.operators import propagation

    both = spark.createDataFrame([(a, b, 1) for a in range(6) for b in range(6) if abs(a - b) in (1, 4)], "node int, nbr int, polarity int")
    asked = spark.createDataFrame([(s, s) for s in range(6)], "scenario int, target int")
    many = prediction.flow(asked, both, k).where("scenario = 2").orderBy("rank").collect()
    one = propagation.spread(spark.createDataFrame([(2, 1.0)], "node int, impact double"), both, keep=0.6).orderBy(F.desc(F.round("impact", 9)), "node").limit(k).collect()
    assert [r.node for r in many] == [r.node for r in one]
    assert [r.node for r in prediction.truth(asked, both, k).where("scenario = 2").orderBy("rank").collect()] == [r.node for r in propagation.strongest(spark.createDataFrame([(2, 1.0)], "node int, impact double"), both, k=k).collect()]
