"""Closed-form values on small graphs and series."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from tidemesh.operators import phase, planning, propagation, retrieval, series, similarity, supervision, topology
from tidemesh.sources import graphs, sinks
from tidemesh.streaming import activity


def pairs(spark, rows):
    return spark.createDataFrame([(u, v, float(w)) for u, v, w in rows], "u string, v string, weight double")


def test_chain_spread(spark):
    adj = graphs.both_ways(pairs(spark, [("a", "b", 1), ("b", "c", 1)])).withColumn("polarity", F.lit(1))
    seed = spark.createDataFrame([("a", 1.0)], "node string, impact double")
    assert {r.node: r.impact for r in propagation.spread(seed, adj).collect()} == {"a": 1.25, "b": 0.625, "c": 0.25}


def test_negative_polarity_flips_the_sign(spark):
    adj = graphs.both_ways(pairs(spark, [("a", "b", 1)])).withColumn("polarity", F.lit(-1))
    seed = spark.createDataFrame([("a", 1.0)], "node string, impact double")
    assert {r.node: r.impact for r in propagation.spread(seed, adj).collect()} == {"a": 1.25, "b": -0.5}


def test_complete_graph_of_four(spark):
    k4 = pairs(spark, [(x, y, 1) for x in "abcd" for y in "abcd" if x < y])
    three = topology.triangles(k4)
    four = topology.four_cliques(three, k4)
    assert three.count() == 4 and four.count() == 1
    nodes = k4.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    assert {(r.triangles, r.cliques) for r in topology.participation(nodes, three, four).collect()} == {(3, 1)}


def test_resilience_of_a_recovery(spark):
    rows = spark.createDataFrame([("r", i, x) for i, x in enumerate([4.0, 5.0, 3.0, 2.0, 1.0])], "run string, i int, x double")
    r = series.resilience(rows, "run", ["i"]).first()
    assert (r.recovery_steps, r.overshoot, r.settling) == (4, 1.0, 5) and abs(r.path - 5) < 1e-12
    assert tuple(series.recovery(series.resilience(rows, "run", ["i"]), "run").first()) == ("r", 0.75, 0.6)


def test_state_classes(spark):
    rows = spark.createDataFrame([(0.75, 0.45, 2.0), (0.4, 0.65, 5.5), (0.3, 0.2, 7.0)], "r double, s double, d double")
    assert [x[0] for x in rows.select(series.state_class(F.col("r"), F.col("s"), F.col("d"))).collect()] == ["stable_routine", "adaptive", "high_flux"]


def test_routes_and_guardrail(spark):
    rows = spark.createDataFrame([("Predict it",), ("what if not",), ("exchange",), ("show",), (None,)], "t string")
    assert [x[0] for x in rows.select(retrieval.route(F.col("t"))).collect()] == ["predict", "intervene", "intervene", "describe", "describe"]
    rows = spark.createDataFrame([("My MOTIVATION and personality",), ("none",)], "t string")
    assert [x[0] for x in rows.select(retrieval.blocked_by(F.col("t"))).collect()] == ["personality", None]


def test_mapping_keeps_the_first_kind_and_skips_null_ends(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", "a", "x", None), (2, None, "b", "y", "z"), (3, "2024-01-02", "x", "x", "q")], "n int, ts string, actor string, asset string, peer string")
    nodes, edges = graphs.mapped(rows, {"actor": "person", "asset": "asset"}, [("actor", "asset", "own", 1.0), ("asset", "peer", "dep", -1.0)], "ts", ["n"])
    assert {(r.id, r.kind) for r in nodes.collect()} == {("a", "person"), ("x", "asset"), ("q", "entity")}
    assert sorted((r.src, r.dst, r.weight) for r in edges.collect()) == [("a", "x", 1.0), ("x", "q", 0.0), ("x", "x", 1.0)]


def runs(spark, values):
    return spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(values)], "run string, i int, x double")


def test_slowing_of_flat_short_and_straight_series(spark):
    assert series.slowing(runs(spark, [1, 2]), "run", ["i"]).first().slowing == 0
    assert series.slowing(runs(spark, [1, 1, 1, 1]), "run", ["i"]).first().autocorrelation == 0
    assert abs(series.slowing(runs(spark, [1, 2, 3, 4]), "run", ["i"]).first().autocorrelation - 1) < 1e-9


def test_triggers_basin_and_alignment(spark):
    rows = [("r", 1, 0.9, 0.2, 1.5, "stable_routine"), ("r", 2, 0.5, 0.6, 3.0, "adaptive"), ("r", 3, 0.5, 0.65, 3.1, "high_flux")]
    states = spark.createDataFrame(rows, "run string, i int, regularity double, speed double, density double, label string")
    got = series.triggers(states, "run", ["i"]).orderBy("i").collect()
    assert [(r.was, r.label, r.reasons) for r in got] == [("stable_routine", "adaptive", "speed_jump,regularity_drop,density_jump"), ("adaptive", "high_flux", "state_boundary_crossed")]
    assert got[0].confidence == 1.0
    b = series.basin(states, "run", ["i"], ["regularity", "speed", "density"]).first()
    assert b.radius == 0 and abs(b.occupancy - 1 / 3) < 1e-12
    assert series.alignment(states, "run", ["i"], {"speed": 1.0, "regularity": 1.0}).first().aligned == 0.5


def test_components_of_a_long_chain_and_a_pair(spark):
    chain = pairs(spark, [(f"n{i:02}", f"n{i + 1:02}", 1) for i in range(30)] + [("x", "y", 1)])
    got = {r.node: r.component for r in topology.components(graphs.both_ways(chain)).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n00"} and got["x"] == got["y"] == "x" and len(got) == 33
    assert topology.components(graphs.both_ways(pairs(spark, []))).count() == 0


def test_components_of_many_rounds_keep_their_estimate_small(spark):
    names = list(range(16))
    random.Random(1).shuffle(names)
    found = topology.components(graphs.both_ways(pairs(spark, [(f"n{u:02}", f"n{v:02}", 1) for u, v in zip(names, names[1:])])))
    assert {r.component for r in found.collect()} == {"n00"}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1e9


def test_components_over_all_line_items(spark, tmp_path):
    from tidemesh.plans import catalogue

    rng = random.Random(9)
    lines = [(rng.randrange(30), rng.randrange(40), rng.choice([1.0, 20.0, 44.0, 50.0, None])) for _ in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for order, supplier, _ in lines:
        for other, at, _ in lines:
            if order == other and supplier != at:
                low, high = sorted((find(supplier), find(at)))
                root[high] = low
    want = {x: find(x) for x in root}
    assert {r.node: r.component for r in catalogue.QUERIES["components_whole"](spark, str(tmp_path)).collect()} == want
    assert {r.node: r.component for r in catalogue.QUERIES["components"](spark, str(tmp_path)).collect()} != want


def test_simplex_pressure_of_equal_nodes(spark):
    k4 = pairs(spark, [(x, y, 1) for x in "abcd" for y in "abcd" if x < y])
    three = topology.triangles(k4)
    impact = spark.createDataFrame([(x, 2.0) for x in "abcd"], "node string, impact double")
    assert {r.pressure for r in topology.simplex_pressure(impact, three, topology.four_cliques(three, k4)).collect()} == {1.0}


def test_nearest_vectors_with_null_and_zero(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0])], "id int, v array<double>")
    got = similarity.cosine_topk(rows.where("id = 1"), rows, "id", "v", 3).orderBy("rank").collect()
    assert [r.item for r in got] == [2, 3, 5] and got[2].score == 0


def test_nearest_vectors_are_the_plain_ones(spark):
    rng = random.Random(4)
    vec = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(90)]
    rows = [(f"i{i:03}", vec[i % 60] if i < 200 else vec[7]) for i in range(260)]  # many copies, so ties at every rank
    rows += [("n1", None), ("n2", [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), ("n3", [1.0]), ("n4", [2.0]), ("n5", []), ("z", [0.0] * 7), ("x", [float("nan")] * 7), (None, vec[3])]
    table = spark.createDataFrame(rows, "id string, v array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    plain = table.where("v is not null").select(F.col("id").alias("item"), F.expr("transform(v, x -> x / (sqrt(aggregate(transform(v, y -> y * y), 0D, (s, y) -> s + y)) + 1e-12D))").alias("v"))
    pairs = plain.select(F.col("item").alias("query"), F.col("v").alias("w")).crossJoin(plain).where("query <> item")
    scored = pairs.select("query", "item", F.round(dot(F.col("v"), F.col("w")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    want = scored.withColumn("rank", rank).where("rank <= 4")
    got = similarity.cosine_topk(table, table, "id", "v", 4)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # no expression a pair
    assert similarity.cosine_topk(table.limit(0), table.limit(0), "id", "v", 4).count() == 0


def test_margin_and_cross_scale(spark):
    values = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 1.0), ("z", 0.0)], "cluster string, value double")
    assert abs(similarity.margin(values).first().margin - 0.5) < 1e-9
    assert {r.cluster: r.score for r in similarity.cross_scale(values).collect()} == {"a": 1.0, "b": 1.0, "z": 1.0}
    assert similarity.margin(values.where("cluster = 'a'")).first().margin > 0.99


def test_edges_between_disagreeing_nodes_are_dropped_first(spark):
    edges = pairs(spark, [("a", "b", 0.8), ("b", "c", 0.8), ("a", "c", 0.8)])
    impact = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 0.9)], "node string, impact double")
    kept = [(r.u, r.v) for r in planning.drop_scores(edges, impact, 0.3).orderBy("score").collect()]
    assert kept[-1] == ("a", "c")
    assert planning.drops(edges, impact, 0.0, 1.0).count() == 3


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = spark.createDataFrame([("u", "2024-01-01 10:00:00"), ("u", "2024-01-01 11:00:00"), ("u", "2024-01-02 10:00:00"), ("w", None)], "who string, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = activity.windowed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "who", "t", late="1 hour")
    q = stream.writeStream.format("memory").queryName("windowed_rows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("windowed_rows").collect()) == sorted(activity.windowed(rows, "who", "t").collect())


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, value double")
    sinks.csv_report(rows, f"{tmp_path}/csv")
    sinks.json_trace(rows, f"{tmp_path}/json")
    assert {(r.name, r.value) for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()} >= {("a", "0.500000")}
    assert {r.name for r in spark.read.json(f"{tmp_path}/json").collect()} == {"a", "b"}


def test_an_impact_that_cancels_pushes_on(spark):
    # b and c reach d with opposite signs, so d has 0 and still passes on to e with sign +1
    adj = spark.createDataFrame([("a", "b", 1), ("a", "c", -1), ("b", "d", 1), ("c", "d", 1), ("d", "e", 1)], "node string, nbr string, polarity int")
    seed = spark.createDataFrame([("a", 1.0)], "node string, impact double")
    got = {r.node: r.impact for r in propagation.spread(seed, adj).collect()}
    assert got["d"] == 0 and got["e"] == 0.125


def test_nodes_without_an_impact_have_none(spark):
    edges = pairs(spark, [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0)])
    impact = spark.createDataFrame([("a", 1.0)], "node string, impact double")
    assert planning.drop_scores(edges, impact, 2.0).count() == 3 and planning.drops(edges, impact, 5.0, -1.0).count() == 1
    three = topology.triangles(edges)
    assert topology.simplex_pressure(impact, three, topology.four_cliques(three, edges)).count() == 3


def test_describe_falls_back_to_degrees(spark):
    edges = spark.createDataFrame([(1, "a", "b", "x", 1.0), (2, "b", "c", "x", 5.0), (3, "d", "d", "x", 0.5)], "ord int, src string, dst string, layer string, weight double")
    assert [r.ord for r in retrieval.described(edges, "c").collect()] == [2]
    assert [(r.ord, r.score) for r in retrieval.described(edges, "nothing here").collect()] == [(2, 8), (1, 4), (3, 4)]
    told = retrieval.description(retrieval.described(edges, "nothing here")).first()
    assert (told.evidence, told.edges, told.uncertainty) == ([2, 1, 3], 3, 0.2) and told.layers == edges.select("layer").distinct().count()
    assert tuple(retrieval.description(retrieval.described(edges.limit(0), "c")).first()) == ([], 0, 0, 0.2)


def test_edge_delta(spark):
    schema = "src string, dst string, weight double"
    before = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("c", "d", 2.0), ("e", "f", 1.0), ("g", "h", 1e-10)], schema)
    after = spark.createDataFrame([("b", "a", 1.0), ("e", "f", 1.0 + 1e-12), ("x", "y", 0.25), ("g", "h", 3.0)], schema)
    got = [(r.u, r.v, r.kind, round(r.delta, 6)) for r in retrieval.edge_delta(before, after).collect()]
    assert got == [("g", "h", "added", 3.0), ("c", "d", "removed", -2.0), ("a", "b", "weight", -0.5), ("x", "y", "added", 0.25)]


def test_phases_of_flat_short_and_missing_series(spark):
    rows = [("flat", i, 1.0, 1.0, 1.0, 1.0) for i in range(4)] + [("one", 0, 1.0, 2.0, 3.0, 4.0)] + [("up", i, float(i), float(i), float(i), -float(i)) for i in range(4)]
    table = spark.createDataFrame(rows, "run string, i int, speed double, dist double, tension double, objective double")
    got = {r.run: r for r in phase.analysis(table, "run", ["i"]).collect()}
    assert (got["flat"].critical, got["flat"].coherence, got["flat"].regime, got["flat"].persistence) == (0.0, 1.0, "calm", 1.0)
    assert (got["one"].n, got["one"].critical, got["one"].warning) == (1, 0.0, 0.0)
    assert got["up"].hysteresis == 1.0 and got["up"].broken == 1.0 and abs(got["up"].coherence - 2 / 3) < 1e-9 and got["up"].flip_rate == 0
    missing = spark.createDataFrame([("r", 0, None), ("r", 1, 2.0), ("r", 2, None)], "run string, i int, x double")
    assert [r.x for r in phase.padded(missing, "run", ["i"], ["x"]).orderBy("i").collect()] == [0.0, 2.0, 2.0]


def test_merge_trim_and_budgets(spark):
    one = spark.createDataFrame([("a", "b", 0), ("c", "d", 1)], "u string, v string, ord int")
    two = spark.createDataFrame([("b", "a", 0), ("e", "f", 1)], "u string, v string, ord int")
    assert [tuple(r) for r in supervision.merged(one, two).collect()] == [("a", "b"), ("c", "d"), ("e", "f")]
    budgets = spark.createDataFrame([("a", 0.0)], "node string, budget double")
    assert abs(supervision.recovered(budgets).first().budget - 0.07) < 1e-12 and supervision.mean_budget(budgets.limit(0)).first().budget == 1.0
    state = spark.createDataFrame([("a", "b", 0.6, 1.0, 0, 0), ("a", "c", 0.1, -1.0, 0, 1)], "u string, v string, affinity double, eligibility double, on int, off int")
    signals = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 0.0), ("c", -1.0, 0.0)], "node string, now double, before double")
    after, left = supervision.plasticity(state, signals, budgets.withColumn("budget", F.lit(1.0)))
    got = {r.v: r for r in after.collect()}
    assert (got["b"].on, got["b"].off, got["c"].on, got["c"].off) == (1, 0, 0, 2) and got["b"].affinity > 0.6 and got["c"].affinity < 0.1
    assert {r.node for r in left.where("budget < 1").collect()} == {"a", "b"} and supervision.trimmed(after, 1).first().v == "b"


def test_forgetting_of_lone_and_split_nodes(spark):
    adj = graphs.both_ways(pairs(spark, [("a", "b", 1), ("c", "d", 1)]))
    chosen = spark.createDataFrame([(x,) for x in "abcz"], "node string")
    r = supervision.forgetting(chosen, adj, 1.0).first()
    assert (r.loss, r.connectivity) == (0.25, 0.5) and abs(r.forgetting - 0.35) < 1e-12
    lone = supervision.forgetting(chosen.where("node = 'z'"), adj).first()
    assert (lone.loss, lone.connectivity) == (1.0, 1.0)
