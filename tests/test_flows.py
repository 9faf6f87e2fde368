"""Forests, bridges and flow decomposition against plain Python and dense algebra."""

import random

import numpy as np
import pytest
from tidemesh.operators import flows, forest

GRAPHS = {
    "path": [(k, k + 1) for k in range(5)],
    "two cycles on a bridge": [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (7, 8)],
    "parallel": [(0, 1), (1, 0), (1, 2), (5, 6), (6, 6)],
    "random": None,
}


def graph(name):
    if GRAPHS[name] is not None:
        return GRAPHS[name]
    rng = random.Random(5)
    return [tuple(rng.sample(range(14), 2)) for _ in range(15)]


def count(nodes, edges):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in edges:
        label[root(a)] = root(b)
    return len({root(n) for n in nodes})


@pytest.mark.parametrize("name", GRAPHS)
def test_forest_and_bridges(spark, name):
    edges = graph(name)
    pairs = spark.createDataFrame(edges, "u long, v long")
    simple = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    nodes = {n for e in simple for n in e}
    tree = {r.node: r for r in forest.spanning(pairs).collect()}
    assert set(tree) == nodes and sum(r.parent is None for r in tree.values()) == count(nodes, simple)
    assert all((min(r.node, r.parent), max(r.node, r.parent)) in simple and tree[r.parent].depth == r.depth - 1 and tree[r.parent].root == r.root for r in tree.values() if r.parent is not None)
    whole = count(nodes, edges)
    want = {e for e in simple if sum({*x} == {*e} for x in edges) == 1 and count(nodes, [x for x in edges if {*x} != {*e}]) > whole}
    assert {(r.u, r.v) for r in forest.bridges(pairs).collect()} == want
    steps = {}
    for r in forest.cycles(pairs, forest.spanning(pairs)).collect():
        steps.setdefault((r.cycle_u, r.cycle_v), []).append((r.a, r.b))
    assert len(steps) == len(simple) - len(nodes) + whole
    for (u, v), walk in steps.items():
        after = dict(walk)
        assert len(after) == len(walk) >= 3 and all((min(s), max(s)) in simple for s in walk) and after[u] == v
        at = u
        for _ in walk:
            at = after[at]
        assert at == u


def test_no_edges(spark):
    none = spark.createDataFrame([], "u long, v long")
    assert forest.spanning(none).count() == forest.bridges(none).count() == 0
    edges, phi = flows.decompose(spark.createDataFrame([], "ord long, src long, dst long, flow double"), 0)
    assert edges.count() == phi.count() == 0 and flows.norms(edges).first().flow == 0.0


def dense(rows, pinned):
    """Gradient by the pinned system, curl by a basis of all cycles, harmonic as the rest."""
    nodes = sorted({n for _, s, d, _ in rows for n in (s, d)})
    at = {n: k for k, n in enumerate(nodes)}
    b = np.zeros((len(nodes), len(rows)))
    f = np.array([x[3] for x in rows])
    for j, (_, s, d, _) in enumerate(rows):
        if s != d:
            b[at[s], j], b[at[d], j] = -1.0, 1.0
    laplace, right = b @ b.T, b @ f
    k = at[pinned]
    laplace[k], laplace[:, k], laplace[k, k], right[k] = 0.0, 0.0, 1.0, 0.0
    phi = np.linalg.solve(laplace + 1e-6 * np.eye(len(nodes)), right)
    gradient = b.T @ phi
    last = {}
    for j, (_, s, d, _) in enumerate(rows):
        if s != d:
            last[frozenset((s, d))] = j
    keep = sorted(last.values())
    _, sizes, basis = np.linalg.svd(b[:, keep])
    cycle = basis[(sizes > 1e-9).sum() :] if len(keep) else np.zeros((0, 0))
    curl = np.zeros(len(rows))
    curl[keep] = cycle.T @ (cycle @ (f - gradient)[keep])
    return phi, gradient, curl


@pytest.mark.parametrize("name", ["parallel", "random"])
def test_decomposition_is_the_dense_one(spark, name):
    rng = random.Random(7)
    edges = graph(name) + [(0, 0), (1, 2), (2, 1)]
    rows = [(k, s, d, rng.uniform(-2, 2)) for k, (s, d) in enumerate(edges)]
    parts, phi = flows.decompose(spark.createDataFrame(rows, "ord long, src long, dst long, flow double"), 0)
    want_phi, gradient, curl = dense(rows, 0)
    got = {r.ord: r for r in parts.collect()}
    assert len(got) == len(rows) and np.allclose([r.phi for r in phi.orderBy("node").collect()], want_phi, atol=1e-7)
    for k, (_, _, _, f) in enumerate(rows):
        r = got[k]
        assert abs(r.flow - f) < 1e-12 and abs(r.gradient + r.curl + r.harmonic - f) < 1e-9
        assert abs(r.gradient - gradient[k]) < 1e-6 and abs(r.curl - curl[k]) < 1e-6
    n = flows.norms(parts).first()
    assert abs(n.flow - np.linalg.norm([x[3] for x in rows])) < 1e-9 and abs(n.curl - np.linalg.norm(curl)) < 1e-6


def test_curl_does_not_depend_on_the_basis(spark):
    """Projecting on the cycles of the forest gives the same curl."""
    rng = random.Random(9)
    edges = sorted({tuple(sorted(rng.sample(range(8), 2))) for _ in range(12)})
    rows = [(k, s, d, rng.uniform(-1, 1)) for k, (s, d) in enumerate(edges)]
    df = spark.createDataFrame(rows, "ord long, src long, dst long, flow double")
    parts, _ = flows.decompose(df, 0)
    pairs = df.selectExpr("src as u", "dst as v")
    at = {e: k for k, e in enumerate(edges)}
    basis = {}
    for r in forest.cycles(pairs, forest.spanning(pairs)).collect():
        row = basis.setdefault((r.cycle_u, r.cycle_v), np.zeros(len(edges)))
        row[at[min(r.a, r.b), max(r.a, r.b)]] = 1.0 if r.a < r.b else -1.0
    c = np.array(list(basis.values()))
    got = parts.orderBy("ord").toPandas()
    rest = (got.flow - got.gradient).to_numpy()
    assert np.allclose(c.T @ np.linalg.solve(c @ c.T, c @ rest), got["curl"], atol=1e-6) and np.abs(got["harmonic"]).max() < 1e-5


def test_rounds_are_bounded(spark):
    pairs = spark.createDataFrame([(k, k + 1, 1) for k in range(8)], "u long, v long, n long")
    right = spark.createDataFrame([(k, float(k - 4)) for k in range(9)], "node long, b double")
    with pytest.raises(ArithmeticError):
        flows.solve(pairs, right, most=2)


def test_bridges_deal_links_once_and_keep_order_0_from_part_0(spark, monkeypatch, tmp_path):
    from tidemesh.plans import structure

    met = []
    monkeypatch.setattr(forest, "meeting", lambda *a: met.append(a))
    lines = [(0, 0), (0, 5), (7, 0), (7, 5), (8, 5), (8, 5), (9, 5), (4, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r.u, r.v) for r in structure.order_bridges(spark, str(tmp_path)).collect()} == {(-5, 9), (-3, 4)}
    assert not met  # no common ancestors of all lines
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("graph_")]
