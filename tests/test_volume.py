"""What is dealt out, sorted and written stays narrow; plans and tables are looked at, not times."""

from pyspark.sql import functions as F
from tidemesh.operators import flows, validation
from tidemesh.plans import calibration
from tidemesh.sources import calendar, graphs

SF = "/root/testdata/sf0.001"


def nodes_of(plan):
    return [plan, *[x for i in range(plan.children().size()) for x in nodes_of(plan.children().apply(i))]]


def test_orders_meet_customers_before_lines(spark):
    plan = graphs.trade(spark, SF)._jdf.queryExecution().optimizedPlan()
    joins = [n for n in nodes_of(plan) if n.nodeName() == "Join" and "o_custkey" in n.condition().toString()]
    assert joins and not any("l_orderkey" in n.output().toString() for n in joins)


def test_repeated_names_are_counted_not_sorted(spark):
    rows = [("a", i, "x", "y", "l", 1.0, 1) for i in range(3000)] + [(None, i, "x", "y", "l", 1.0, 1) for i in range(3000, 3003)] + [("b", 4000, "x", "y", "l", 1.0, 1)]
    edges = spark.createDataFrame(rows, "edge_id string, ord long, src string, dst string, layer string, weight double, ts long")
    found = validation.issues(edges, spark.createDataFrame([("x",), ("y",)], "id string"))
    got = {(r.code, r.edge_id): r.n for r in found.groupBy("code", "edge_id").agg(F.count("*").alias("n")).collect()}
    assert got == {("duplicate_interaction_id", "a"): 2999, ("duplicate_interaction_id", None): 2}
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_decomposed_edges_are_written_once(spark, monkeypatch):
    written, save = [], flows.saved
    monkeypatch.setattr(flows, "saved", lambda df: written.append(df.columns) or save(df))
    rows = [(0, 1, 2, 1.0), (1, 2, 3, 2.0), (2, 1, 3, 0.5), (3, 1, 2, 4.0), (4, 3, 3, 1.0)]
    parts, _ = flows.decompose(spark.createDataFrame(rows, "ord long, src long, dst long, flow double"), 1)
    assert not any("gradient" in c for c in written)
    got = parts.collect()
    assert len(got) == 5 and all(abs(r.gradient + r.curl + r.harmonic - r.flow) < 1e-9 for r in got)


def test_kinds_of_ids_need_no_sorted_rows(spark):
    rows = [(2, "a", ["b"], "p", None, 1.0), (1, "p", [], "b", None, 1.0)]
    table = spark.createDataFrame(rows, "event long, organiser string, attendees array<string>, location string, start timestamp, hours double")
    found = calendar.nodes(table)
    assert {r.id: r.kind for r in found.collect()} == {"a": "person", "b": "place", "p": "person"}
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    over_rows = [x for x in lines if "functions=[partial_min" in x and "keys=[" in x]
    assert any("HashAggregate" in x and "partial_min(event" in x for x in over_rows)


def test_components_take_no_more_links_than_lines(spark, tmp_path):
    lines = [(1, s) for s in range(12)] + [(2, 20), (2, 20), (3, None), (3, 11), (3, 30), (None, 30), (None, 31)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    links = graphs.co_supply_links(spark, str(tmp_path), None)
    assert sorted(tuple(r) for r in links.where("node < nbr").collect()) == [(0, s) for s in range(1, 12)] + [(11, 30)]
    assert links.count() == 24


def test_pairs_of_meetings_are_dealt_out_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(calibration, "_LINES", 500)
    found = calibration.calendar_edges(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    dealt = [n for n in nodes_of(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    assert [n.numPartitions() for n in dealt] == [-(-lines // 500)]  # the tasks grow with the input, what one of them holds does not


def test_pairs_of_all_lines_are_dealt_out_by_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphs, "LINES", 10)
    rows = [(k // 3, k % 7, 1.0) for k in range(60)] + [(0, 0, 1.0), (0, 0, 2.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = graphs.co_supply_orders(spark, str(tmp_path))
    orders = {}
    for order, supplier, _ in rows:
        orders.setdefault(order, set()).add(supplier)
    want = sorted((a, b) for s in orders.values() for a in s for b in s if a < b)
    assert sorted((r.u, r.v) for r in pairs.collect()) == want
    dealt = [n.optNumPartitions().get() for n in nodes_of(pairs._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    assert dealt == [7, 7]
    counted = graphs.co_supply(spark, str(tmp_path), None)
    assert {(r.u, r.v): r.weight for r in counted.collect()} == {p: want.count(p) for p in want}
