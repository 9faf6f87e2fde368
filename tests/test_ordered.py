"""Windows in blocks against those over whole runs and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemesh.operators import calibration, series, validation
from tidemesh.operators.ordered import carried, number, own, upto, whole

BLOCKS = (1, 3, 50)


def cut(width):
    return F.floor((F.col("i") + 7) / width)


@pytest.fixture(scope="module")
def runs(spark):
    """Runs of 1 to 60 steps with gaps, equal neighbours, null values and a null name; one run has most rows."""
    rng = random.Random(5)
    rows = []
    for name, n in (("a", 60), ("b", 1), ("c", 2), ("d", 3), (None, 9), ("e", 4)):
        at = -4
        for _ in range(n):
            at += rng.choice([1, 1, 2, 9])
            x = rng.choice([None, 0.0, 1.0, 1.0, 2.5, -3.0, rng.random()])
            rows.append((name, at, x, rng.choice("uvv")))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "run string, i int, x double, label string").cache()


def by_run(df):
    out = {}
    for r in sorted(df.select("run", "i", "x", "label").collect(), key=lambda r: r.i):
        out.setdefault(r.run, []).append(r)
    return out


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", BLOCKS)
def test_carried(runs, width):
    rows, w = carried(runs.withColumns({"n": F.lit(1), "top": F.col("x")}), ["run"], ["i"], cut(width), last=("x", "label"), sums=("n",), maxima=("top",), ends="x")
    got = own(rows.withColumns({"k": number(w), "lag": F.lag("x").over(w), "was": F.lag("label").over(w), "count": F.sum("n").over(upto(w)), "most": F.max("top").over(upto(w)), "first": whole("_first", w), "end": whole("_last", w)}))
    found = {(r.run, r.i): (r.k, r.lag, r.was, r["count"], r.most, r.first, r.end) for r in got.collect()}
    assert got.count() == runs.count()
    for run, steps in by_run(runs).items():
        for k, r in enumerate(steps):
            seen = [s.x for s in steps[: k + 1] if s.x is not None]
            before = (steps[k - 1].x, steps[k - 1].label) if k else (None, None)
            assert found[run, r.i] == (k + 1, *before, k + 1, max(seen, default=None), steps[0].x, steps[-1].x)


@pytest.mark.parametrize("width", BLOCKS)
def test_series_in_blocks(runs, width):
    known = runs.fillna(0.5, ["x"])
    for measure in (
        lambda b: series.transitions(runs, "run", ["i"], block=b), lambda b: series.persistence(runs, "run", ["i"], block=b), lambda b: series.flips(runs.where("run is not null"), "run", ["i"], block=b),
        lambda b: series.flips(known.where("run is not null"), "run", ["i"], eps=0.0, block=b), lambda b: series.resilience(known, "run", ["i"], block=b), lambda b: series.slowing(known, "run", ["i"], block=b),
    ):
        assert rounded(measure(cut(width))) == rounded(measure(None))


def test_series_plain(runs):
    known = runs.fillna(0.5, ["x"])
    steps = by_run(known)
    longest = {r.run: (r.longest, r.length, r.switches) for r in series.persistence(known, "run", ["i"], cut(3)).collect()}
    pairs = {}
    for run, rows in steps.items():
        stretches = [1]
        for a, b in zip(rows, rows[1:]):
            pairs[a.label, b.label] = pairs.get((a.label, b.label), 0) + 1
            stretches = stretches[:-1] + [stretches[-1] + 1] if a.label == b.label else stretches + [1]
        assert longest[run] == (max(stretches), len(rows), len(stretches) - 1)
    assert {(r.src, r.dst): r.n for r in series.transitions(known, "run", ["i"], cut(3)).collect()} == pairs
    turned = {r.run: (r.flips, r.chances) for r in series.flips(known.where("run is not null"), "run", ["i"], block=cut(3)).collect()}
    for run, rows in steps.items():
        if run is not None:
            signs = [1 if b.x > a.x else -1 for a, b in zip(rows, rows[1:]) if abs(b.x - a.x) > 1e-9]
            assert turned[run] == ((sum(a != b for a, b in zip(signs, signs[1:])), len(signs) - 1) if signs else (0, 0))
    for r in series.resilience(known, "run", ["i"], block=cut(3)).collect():
        x = [s.x for s in steps[r.run]]
        half = [k for k, v in enumerate(x, 1) if v <= x[0] / 2]
        far = [k for k, v in enumerate(x, 1) if abs(v - x[-1]) > max(1e-6, abs(x[-1]) * 0.05)]
        assert (r.n, r.first_value, r.last_value, r.recovery_steps, r.settling) == (len(x), x[0], x[-1], half[0] if half else len(x), (far[-1] if far else 0) + 1)
        assert abs(r.path - sum(abs(b - a) for a, b in zip(x, x[1:]))) < 1e-9 and r.overshoot == max(0.0, max(x) - x[0])
    assert series.persistence(known.limit(0), "run", ["i"], cut(3)).count() == 0


@pytest.mark.parametrize("q", (0.0, 0.5, 0.9, 1.0))
def test_quantile_radius(runs, q):
    distances = runs.select("run", F.abs("x").alias("d")).where("d is not null")
    got = {r.run: r.radius for r in series.quantile_radius(distances, "run", q).collect()}
    values = {}
    for r in distances.collect():
        values.setdefault(r.run, []).append(r.d)
    assert got == {run: sorted(v)[round((len(v) - 1) * q)] for run, v in values.items()}
    same = distances.withColumn("d", F.lit(2.0))
    assert {r.radius for r in series.quantile_radius(same, "run", q).collect()} == {2.0}


@pytest.mark.parametrize("streak", (1, 2, 3))
def test_converged_in_blocks(spark, streak):
    rng = random.Random(8)
    rows = [(run, i, rng.choice([0.1, 0.105, 0.9]), 0.1, 0.05, 0.0, 0.6, rng.random() < 0.9, True) for run in "abc" for i in range(40)]
    steps = spark.createDataFrame(rows, "run string, i int, distance double, before double, after double, shift double, consistency double, flat boolean, still boolean")
    got = {r.run: r.ended for r in calibration.converged(steps, "run", ["i"], streak, cut(3)).collect()}
    for run in "abc":
        mine = [r for r in rows if r[0] == run]
        calm = [False] + [abs(b[2] - a[2]) < 0.015 and b[7] for a, b in zip(mine, mine[1:])]
        ends = [k for k in range(streak, len(calm) + 1) if all(calm[k - streak : k])]
        assert got[run] == (ends[0] if ends else None)


def test_lanes_in_blocks(spark):
    rng = random.Random(4)
    rows = [(str(k), k, "a", rng.choice("bc"), "l", 1.0, rng.randint(0, 400) if k % 7 else None) for k in range(80)]
    edges = spark.createDataFrame(rows, "edge_id string, ord int, src string, dst string, layer string, weight double, ts int")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    late, top = set(), {}
    for name, _, _, dst, _, _, ts in rows:
        if ts is not None:
            if top.get(dst, -1) > ts:
                late.add(name)
            top[dst] = max(top.get(dst, -1), ts)
    for width in BLOCKS:
        assert {r.edge_id for r in validation.issues(edges, nodes, block=F.floor(F.col("ord") / width)).collect()} == late


def test_links_of_ranges(spark):
    """Links between neighbours of the order are the same however it is cut, with ties and at the ends of ranges."""
    from tidemesh.operators import propagation

    rng = random.Random(5)
    impact = [(f"n{k:03}", rng.choice([-1.5, -0.5, -0.25, 0.1, 0.25, 0.5, 0.5, 1.0, 2.0])) for k in range(60)]
    order = sorted((x for x in impact if abs(x[1]) >= 0.25), key=lambda x: (-abs(x[1]), x[0]))
    near = {(a[0], b[0]) for a, b in zip(order, order[1:]) if rng.random() < 0.3}
    expected = [(k + 1, a[0], b[0]) for k, (a, b) in enumerate(zip(order, order[1:])) if a[1] * b[1] >= 0 and (a[0], b[0]) not in near]
    rows = spark.createDataFrame([*impact, ("unknown", None)], "node string, impact double")
    adjacency = spark.createDataFrame([*near, *[(b, a) for a, b in near]], "node string, nbr string")
    for parts in (None, 1, 7, 80):
        assert [tuple(r) for r in propagation.rewires(rows, adjacency, 100, parts).collect()] == expected
    assert [tuple(r) for r in propagation.rewires(rows, adjacency).collect()] == expected[:3]
    assert propagation.rewires(rows.limit(0), adjacency).count() == 0
