"""Adapters and their sources, and affinities over several steps against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from tidemesh.operators import plasticity, supervision
from tidemesh.sources import adapters

M = adapters.Mapping((("actor", "person"), ("asset", "asset")), (("actor", "asset", "own", 1.0), ("asset", "peer", "dep", -1.0)), "ts", "asset", ("n",))
T = datetime.datetime(2024, 1, 1)
ROWS = [(1, T, "a", "x", None), (2, None, "b", "y", "z"), (3, T + datetime.timedelta(days=1), "x", "y", "q"), (4, T, "a", "a", "q")]
SCHEMA = "n int, ts timestamp, actor string, asset string, peer string"


def test_build_in_one_call(spark):
    b = adapters.build(spark.createDataFrame(ROWS, SCHEMA), M, "g")
    edges = {r.edge_id: (r.src, r.dst, r.layer, r.weight, r.metadata) for r in b.edges.collect()}
    # numbers go by edges, not by records, and the record without a time has none
    want = [("a", "x", "own", 1.0), ("x", "y", "own", 1.0), ("y", "q", "dep", 0.0), ("a", "a", "own", 1.0), ("a", "q", "dep", 0.0)]
    assert edges == {f"g:e:{k}": (*w, {"source_record_idx": str(k)}) for k, w in enumerate(want)}
    assert {(r.id, r.kind) for r in b.nodes.collect()} == {("a", "person"), ("x", "asset"), ("y", "asset"), ("q", "entity")}
    assert [tuple(r) for r in b.issues.collect()] == [("self_loop_not_allowed", "g:e:3")]
    p, report = b.perturbation.first(), b.report.first()
    assert (p.target, p.n, p.ts, p.intensity) == ("y", 2, T + datetime.timedelta(days=1), 1.0)
    assert (report.records, report.edge_rules, report.node_fields, report.errors, report.valid) == (4, 2, 2, 1, False)
    none = adapters.build(spark.createDataFrame([], SCHEMA), M)
    assert none.edges.count() == none.nodes.count() == none.issues.count() == 0 and none.perturbation.first().target is None and none.perturbation.first().ts is not None


def test_names(spark):
    adapters.register("  Mine ", lambda: M)
    assert adapters.get("MINE")() == M and adapters.names() == ["generic", "mine"]
    assert adapters.get("generic")("a", "b").edge_rules == (("a", "b", "default", 1.0),)
    for name in ("", " \t"):
        with pytest.raises(ValueError):
            adapters.register(name, lambda: M)
    with pytest.raises(KeyError):
        adapters.get("other")


def test_a_mapping_is_a_format(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/records")
    adapters.register("asset_records", lambda: M, spark)
    got = spark.read.format("asset_records").load(f"{tmp_path}/records")
    assert [(r.record, r.rule, r.src, r.dst, r.layer, r.weight) for r in got.orderBy("record", "rule").collect()] == [(0, 0, "a", "x", "own", 1.0), (2, 0, "x", "y", "own", 1.0), (2, 1, "y", "q", "dep", 0.0), (3, 0, "a", "a", "own", 1.0), (3, 1, "a", "q", "dep", 0.0)]
    assert got.agg(F.max("ts")).first()[0] == T + datetime.timedelta(days=1)
    (tmp_path / "none").mkdir()
    assert spark.read.format("asset_records").load(f"{tmp_path}/none").count() == 0


def test_numbers_follow_the_order(spark):
    rows = [(k * 7919 % 1000,) for k in range(1000)]
    got = adapters.numbered(spark.createDataFrame(rows, "x int").repartition(7), ["x"], "place").collect()
    assert len(got) == 1000 and all(r.x == r.place for r in got)


def plain_step(state, nodes, edges, impact, risk, k, anchors):
    pairs, budgets, before = state
    for n in nodes:
        budgets[n] = budgets.get(n, 1.0) + 0.07 * (1 - budgets.get(n, 1.0))
    ranked = sorted(impact, key=lambda n: (-abs(impact[n]), n))[:anchors]
    held = {tuple(sorted(e)) for e in edges}
    top, spent, add, drop = max(map(abs, impact.values()), default=0) or 1.0, {}, [], []
    for a, b in sorted({(a, b) for a in ranked for b in ranked if a < b} | held):
        ia, ib, pa, pb = (d.get(n, 0.0) / top for d in (impact, before) for n in (a, b))
        aff, e, on, off = pairs.get((a, b), (0.0, 0.0, 0, 0))
        one = lambda x: max(-1.0, min(1.0, x))
        e = 0.78 * e + 0.22 * (0.7 * one(ia * ib) + 0.3 * one(pa * ib - pb * ia))
        now = max(0.0, min(1.0, aff + k["eta_up"] * max(0.0, e) * budgets.get(a, 1.0) * budgets.get(b, 1.0) * (1 - 0.5 * risk) - k["eta_down"] * max(0.0, -e)))
        for n in (a, b):
            spent[n] = spent.get(n, 0.0) + 0.2 * max(0.0, now - aff)
        on, off = (on + 1, 0) if now >= k["theta_on"] else (0, off + 1) if now <= k["theta_off"] else (0, 0)
        pairs[a, b] = (now, one(e), on, off)
        if (a, b) not in held and on >= k["dwell"]:
            add.append((-now, (a, b)))
        if (a, b) in held and off >= k["dwell"]:
            drop.append((now, (a, b)))
    for n, x in spent.items():
        budgets[n] = max(0.0, min(1.0, budgets.get(n, 1.0) - x))
    return [p for _, p in sorted(add)[:3]], [p for _, p in sorted(drop)[:3]], (pairs, budgets, dict(impact))


def test_three_steps_of_plasticity(spark, tmp_path):
    rng = random.Random(8)
    names = list("abcdefg")
    edges = [("a", "b"), ("b", "c"), ("d", "c"), ("a", "b"), ("e", "e")]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    table = spark.createDataFrame(edges, "src string, dst string")
    knobs = supervision.KNOBS | {"eta_up": 3.0, "theta_on": 0.3, "theta_off": 0.2}
    memory, state = plasticity.fresh(spark), ({}, {}, {})
    for turn in range(3):
        impact = {n: rng.uniform(-1, 1) if turn != 1 else 0.9 for n in names if n != "g"}
        memory, add, drop = plasticity.step(memory, nodes, table, spark.createDataFrame(list(impact.items()), "node string, impact double"), 0.2, knobs, anchors=4)
        want_add, want_drop, state = plain_step(state, names, edges, impact, 0.2, knobs, 4)
        got = {(r.u, r.v): (r.affinity, r.eligibility, r.on, r.off) for r in memory.pairs.collect()}
        assert set(got) == set(state[0]) and all(got[p] == pytest.approx(state[0][p], abs=1e-12) for p in got)
        assert {r.node: r.budget for r in memory.nodes.collect()} == pytest.approx(state[1], abs=1e-12)
        assert (add, drop) == (want_add, want_drop)
        plasticity.store(memory, f"file://{tmp_path}/m", turn)
    assert want_drop and plasticity.load(spark, f"file://{tmp_path}/m").pairs.count() == memory.pairs.count()
    assert plasticity.load(spark, f"file://{tmp_path}/m", 0).pairs.count() <= memory.pairs.count()
    with pytest.raises(FileNotFoundError):
        plasticity.load(spark, f"file://{tmp_path}/m", 9)
