"""Dynamics, gains, control and communities against plain Python."""

import math
import random
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F
from tidemesh.operators import communities, dynamics, gains


def plain_run(x, history, shock, steps=4, dt=1.0):
    x, shock = np.array(x), np.array(shock)
    h = np.array(history or [x])
    base = 1 + 4 * min(0.85, max(0.0, 0.6 * x[1] + 0.3 * min(1.0, x[3] / 10)))
    a, r, t = h.mean(0), h.min(0), np.diff(h, axis=0).std(0) if len(h) > 1 else np.zeros(6)

    def velocity(y):
        f = 0.45 * (a - y) + 0.25 * (y - r) + shock + 0.15 * t
        return f / (base * np.clip(np.abs(f) / (0.8 / math.sqrt(6)), 1, 5))

    out = []
    for _ in range(steps):
        one = velocity(x)
        v = (one + velocity(x + 0.5 * dt * one)) / 2
        before, x = x, np.clip(x + dt * v, 0, 10)
        out.append((x, v, np.linalg.norm(x - a), v @ v))
        if np.linalg.norm(x - before) < 0.02:
            return out, True
    return out, False


def test_runs_move_as_in_plain_python(spark):
    rng = random.Random(4)
    state = lambda high: [rng.uniform(0, high) for _ in range(6)]
    rows = [(k, state(8), [state(8) for _ in range(rng.choice([1, 2, 5]))], [rng.uniform(-1, 1) for _ in range(6)]) for k in range(20)]
    rows += [(20, [1.0] * 6, None, None), (21, [2.0] * 6, [], [0.0] * 6), (22, None, None, [9.0] * 6)]
    for steps in (1, 4):
        got = {r.run: r for r in dynamics.simulate(spark.createDataFrame(rows, "run int, state array<double>, history array<array<double>>, shock array<double>"), steps).collect()}
        for k, x, h, s in rows:
            want, stopped = plain_run(x or [0.0] * 6, h, s or [0.0] * 6, steps)
            assert len(got[k].snapshots) == len(want) and got[k].stabilized == stopped
            for g, (x1, v, d, e) in zip(got[k].snapshots, want):
                assert np.allclose(g.state, x1, atol=1e-9) and np.allclose(g.velocity, v, atol=1e-9) and abs(g.distance - d) < 1e-9 and abs(g.energy - e) < 1e-9
    assert got[20].stabilized and len(got[20].snapshots) == 1  # one state that is its own attractor and repeller stands still


def test_clamps_and_adaptation():
    g = gains.Gains()
    assert gains.clamped(g, 0.0) == g
    safe = gains.clamped(g, 2.0)
    assert np.allclose((safe.div, safe.residual, safe.higher), (0.35 * 0.78, 0.5 * 0.82, 0.1 * 0.8))
    assert gains.clamped(gains.Gains(0.1, 0.2, 0.02), 1.0) == gains.Gains(0.1, 0.2, 0.02)
    m = {"objective": 2.0, "residual_ratio": 0.5, "div_before": 1.0, "div_after": 0.5, "energy": 0.0, "saturation": 0.0}
    first = gains.adapted(g, gains.Settings(), m)
    assert (first.objective, first.way_div) == (2.0, 1.0) and np.allclose((first.div, first.residual, first.higher), (0.35 * 1.03, 0.51, 0.101))
    again = gains.adapted(first, gains.Settings(), m)  # not better: the direction turns
    assert (again.way_div, again.way_residual) == (-1.0, -1.0) and np.allclose((again.div, again.residual), ((first.div - 0.02) * 1.03, (first.residual - 0.015) * 1.02))
    calm = gains.adapted(g, gains.Settings(), m | {"residual_ratio": 0.1, "energy": 3.0})
    assert np.allclose((calm.div, calm.residual, calm.higher), (0.35 * 0.995 * 0.97, 0.5 * 0.995 * 0.985, 0.1 * 0.997 * 0.985))


def test_control_looks_ahead(spark):
    rng = random.Random(11)
    names = ["impact", "div", "turn", "still", "phi", "cycle", "higher", "curl", "harmonic"]
    table = np.array([[rng.uniform(-2, 2) for _ in names] for _ in range(12)])
    terms = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(table)], "node int, " + ", ".join(f"{n} double" for n in names))
    m = {"residual_ratio": 0.4, "curl_ratio": 0.3, "harmonic_ratio": 0.2, "cycle_mean": 0.1, "higher_mean": 0.5, "tension": 0.7, "div_before": float(np.linalg.norm(table[:, 1]))}
    _, div, turn, still, phi, cycle, higher, curl, harmonic = table.T
    s, g, speed = gains.Settings(), gains.Gains(), 0.9

    def total(kd, rd, kh):
        out, before, part, ahead = 0.0, div, rd, speed - 0.45
        for n in range(2):
            after = before - part * turn - 0.16 * still
            u = np.clip(-kd * before - 0.15 * phi - 0.2 * ahead - 0.12 * cycle - kh * higher - 0.18 * curl - 0.16 * harmonic, -1, 1)  # the limit is not scaled by the risk here
            out += 0.7**n * (np.linalg.norm(after) + 0.25 * (u @ u) + 0.35 * np.mean(abs(u) >= 0.98) + 0.6 * 0.4 + 0.2 * 0.1 + 0.45 * 0.3 + 0.35 * 0.2 + 0.25 * 0.5 + 0.15 * 0.7)
            before, part, ahead = after, part * rd, ahead * 0.7
        return out

    rows = gains.candidates(terms, g, m, speed).orderBy("ord").collect()
    assert len(rows) == 27 and all(abs(r.total - total(r["div"], r.residual, r.higher)) < 1e-9 for r in rows)
    best = min(rows, key=lambda r: (r.total, r.ord))
    nodes, out, after = gains.control(terms, m, g, speed, risk=0.5)
    kd, kh, limit = best["div"] * 0.89, best.higher * 0.9, 0.825
    want = np.clip(-kd * div - 0.15 * phi - 0.2 * 0.45 - 0.12 * cycle - kh * higher - 0.18 * curl - 0.16 * harmonic, -limit, limit)
    got = nodes.orderBy("node").collect()
    assert np.allclose([r.control for r in got], want, atol=1e-6) and np.allclose([r.controlled for r in got], np.clip(table[:, 0] + want, -10, 10), atol=1e-6)
    assert abs(out["energy"] - want @ want) < 1e-9 and abs(out["gain_div"] - kd) < 1e-12 and after == gains.clamped(gains.adapted(replace(g, div=out["gain_div"], residual=out["gain_residual"], higher=out["gain_higher"]), s, out), 0.5)


def test_terms_of_a_small_graph(spark):
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node long")
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 0, 2, 2.0), (3, 2, 3, 1.0), (4, 2, 3, 1.0)], "ord long, src long, dst long, weight double")
    impact = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, -1.0)], "node long, impact double")
    terms, m = gains.node_terms(nodes, edges, impact, 0)
    got = {r.node: r for r in terms.collect()}
    # closed triangles: all of 0 and 1, one wedge of three at 2
    assert len(got) == 5 and got[0].cycle == 1.0 and got[1].cycle == 0.5 and abs(got[2].cycle + 1 / 3) < 1e-12 and got[3].cycle == got[4].cycle == got[4].div == 0.0
    assert abs(m["div_before"] - math.sqrt(sum(r["div"] ** 2 for r in got.values()))) < 1e-12 and m["flow"] > 0 and m["tension"] > 0
    assert gains.control(terms, m, gains.Gains(), 0.5)[0].count() == 5


def plain_modularity(edges, of):
    m = sum(w for *_, w in edges)
    k = {}
    for u, v, w in edges:
        for n in (u, v):
            k[of[n]] = k.get(of[n], 0) + w
    return sum(w for u, v, w in edges if of[u] == of[v]) / m - sum(x * x for x in k.values()) / (4 * m * m)


def plain_greedy(nodes, edges):
    of = {n: n for n in nodes}
    while True:
        names = sorted(set(of.values()))
        now = plain_modularity(edges, of)
        tries = [(plain_modularity(edges, {n: a if c == b else c for n, c in of.items()}), -i, a, b) for i, (a, b) in enumerate((a, b) for a in names for b in names if a < b)]
        if not tries or max(tries)[0] <= now + 1e-12:
            return now
        _, _, a, b = max(tries)
        of = {n: a if c == b else c for n, c in of.items()}


def test_planted_communities(spark):
    rng = random.Random(3)
    edges = [(a, b, 1.0) for a in range(24) for b in range(a) if rng.random() < (0.9 if a // 8 == b // 8 else 0.05)]
    nodes = spark.createDataFrame([(n,) for n in range(25)], "node long")
    pairs = spark.createDataFrame(edges, "u long, v long, weight double")
    of = {r.node: r.cluster for r in communities.communities(nodes, pairs).collect()}
    assert of == {n: n // 8 * 8 for n in range(24)} | {24: 24}
    q = communities.modularity(pairs, spark.createDataFrame(list(of.items()), "node long, cluster long"))
    assert abs(q - plain_modularity(edges, of)) < 1e-12 and q >= plain_greedy(range(24), edges) - 1e-9


def test_communities_of_a_star_and_of_nothing(spark):
    star = [(0, k, 1.0) for k in range(1, 12)] + [(20, 21, 0.0), (30, 30, 5.0)]
    nodes = spark.createDataFrame([(n,) for n in [*range(12), 20, 21, 30]], "node long")
    of = {r.node: r.cluster for r in communities.communities(nodes, spark.createDataFrame(star, "u long, v long, weight double")).collect()}
    assert all(of[n] == n for n in (20, 21, 30)) and plain_modularity(star[:11], of) >= plain_greedy(range(12), star[:11]) - 0.02
    two = communities.communities(nodes.limit(2), spark.createDataFrame(star, "u long, v long, weight double").where("v < 2"))
    assert {(r.node, r.cluster) for r in two.collect()} == {(0, 0), (1, 1)}
    assert communities.communities(nodes.limit(0), spark.createDataFrame([], "u long, v long, weight double")).count() == 0


def test_graph_of_clusters(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 3.0)], "u string, v string, weight double")
    cluster = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "node string, cluster string")
    assert [(r.src, r.dst, r.weight) for r in communities.cluster_edges(pairs, cluster).collect()] == [("x", "y", 5.0)]
    chain = communities.cluster_edges(pairs.limit(0), cluster).collect()
    assert sorted((r.src, r.dst, r.weight) for r in chain) == [("x", "y", 0.05), ("y", "z", 0.05)]
    assert communities.cluster_edges(pairs.limit(0), cluster.limit(0)).count() == 0


def test_communities_of_noise_settle_in_few_rounds(spark, monkeypatch):
    n, rng = 80, random.Random(5)
    w = {(u, v): float(rng.randint(1, 6)) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.9}
    pairs = spark.createDataFrame([(u, v, x) for (u, v), x in w.items()], "u long, v long, weight double")
    written, save = [], communities.saved
    monkeypatch.setattr(communities, "saved", lambda df: written.append(df) or save(df))
    of = {r.node: r.cluster for r in communities.communities(spark.range(n).toDF("node"), pairs).collect()}
    assert len(of) == n and len(written) < 90
    # no node gains by a move, and no two communities by a merge
    whole, k = sum(w.values()), [0.0] * n
    for (u, v), x in w.items():
        k[u], k[v] = k[u] + x, k[v] + x
    gain = lambda one, two: sum(w.get((min(a, b), max(a, b)), 0.0) / whole - k[a] * k[b] / (2 * whole * whole) for a in one for b in two)
    parts = {c: [a for a in of if of[a] == c] for c in set(of.values())}
    assert len(parts) > 1 and all(c == min(p) for c, p in parts.items())
    for a in of:
        here = gain([a], [b for b in parts[of[a]] if b != a])
        assert all(gain([a], p) <= here + 1e-9 for c, p in parts.items() if c != of[a])
    assert all(gain(p, q) <= 1e-9 for c, p in parts.items() for d, q in parts.items() if c < d)


def settled_noise(spark, n):
    """Communities of a dense random graph, none of whose nodes would gain by a move, nor two by a merge."""
    rng = random.Random(7)
    w = [(u, v, float(rng.randint(1, 6))) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.9]
    pairs = spark.createDataFrame(w, "u long, v long, weight double")
    of = {r.node: r.cluster for r in communities.communities(spark.range(n).toDF("node"), pairs).collect()}
    whole, b, k = sum(x for *_, x in w), np.zeros((n, n)), np.zeros(n)
    for u, v, x in w:
        b[u, v] = b[v, u] = x
    k = b.sum(0)
    b = b / whole - np.outer(k, k) / (2 * whole * whole)
    np.fill_diagonal(b, 0)
    names = sorted(set(of.values()))
    inside = np.array([[of[a] == c for c in names] for a in range(n)], float)
    near = b @ inside
    assert len(names) > 1 and all(c == min(a for a in of if of[a] == c) for c in names)
    assert (near <= (near * inside).sum(1, keepdims=True) + 1e-9).all()
    between = inside.T @ near
    assert (between - np.diag(np.diag(between)) <= 1e-9).all()


def test_communities_of_a_block_need_one_round(spark, monkeypatch):
    written, save = [], communities.saved
    monkeypatch.setattr(communities, "saved", lambda df: written.append(df) or save(df))
    settled_noise(spark, 150)
    assert len(written) < 15


def test_communities_of_many_blocks_settle(spark, monkeypatch):
    monkeypatch.setattr(communities, "BLOCK", 30)
    written, save = [], communities.saved
    monkeypatch.setattr(communities, "saved", lambda df: written.append(df) or save(df))
    settled_noise(spark, 90)
    assert len(written) < 90
