"""Flow-field dynamics of a state: a step machine inside one expression, so all runs move in one narrow pass.

A state is an array of the six features in the order of `FEATURES`.  A run is a row: its state, its history (an array of
states, in order; null or empty means the state alone) and its shock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("social_entropy", "temporal_regularity", "spatial_range", "schedule_density", "network_centrality", "transition_speed")
# Pull to the attractor, push off the repeller, turbulence, longest step, where a run stands still.
PULL, PUSH, TURBULENCE, STEP, STILL = 0.45, 0.25, 0.15, 0.8, 0.02


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it stands in the expression."""
    return F.transform(F.array(value), use)[0]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def _field(history: Column, d: Column) -> Column:
    """Attractor, repeller and turbulence of a feature: mean and minimum of its history, and the standard deviation of
    its steps."""
    values = F.transform(history, lambda s: F.get(s, d))

    def spread(v: Column) -> Column:
        steps = F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda b, a: b - a)
        return F.when(F.size(v) < 2, 0.0).otherwise(let(steps, lambda s: let(_mean(s), lambda m: F.sqrt(_mean(F.transform(s, lambda x: (x - m) * (x - m)))))))

    return let(values, lambda v: F.struct(_mean(v).alias("a"), F.array_min(v).alias("r"), spread(v).alias("t")))


def _velocity(x: Column, field: Column, mass: Column) -> Column:
    force = PULL * (field["a"] - x) + PUSH * (x - field["r"]) + field["s"] + TURBULENCE * field["t"]
    limit = STEP / len(FEATURES) ** 0.5
    return let(force, lambda f: f / (mass * F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.abs(f) / limit))))


def simulate(runs: DataFrame, steps: int = 4, dt: float = 1.0) -> DataFrame:
    """The rows of `runs` (state, history, shock: arrays) with `snapshots`, an array of (state, velocity, distance, energy),
    and `stabilized`.  Midpoint steps; a state stays in 0..10; a run ends early when it moves by less than STILL.  Null
    states and shocks count as zeros."""
    zeros = F.array_repeat(F.lit(0.0), len(FEATURES))
    own = F.coalesce(F.col("state"), zeros)
    history = F.when(F.coalesce(F.size("history"), F.lit(0)) > 0, F.col("history")).otherwise(F.array(own))
    at = F.sequence(F.lit(0), F.lit(len(FEATURES) - 1))
    inertia = F.greatest(F.lit(0.0), F.least(F.lit(0.85), 0.6 * F.get("_x", F.lit(1)) + 0.3 * F.least(F.lit(1.0), F.get("_x", F.lit(3)) / 10)))
    rows = runs.withColumn("_x", own).withColumn("_h", history).withColumn("_s", F.coalesce(F.col("shock"), zeros))
    field = F.transform(at, lambda d: let(_field(F.col("_h"), d), lambda f: F.struct(f["a"].alias("a"), f["r"].alias("r"), f["t"].alias("t"), F.get("_s", d).alias("s"))))
    rows = rows.withColumns({"_f": field, "_m": 1 + 4 * inertia})
    field, mass = F.col("_f"), F.col("_m")

    def velocities(x: Column) -> Column:
        first = F.zip_with(x, field, lambda v, f: _velocity(v, f, mass))
        both = F.zip_with(F.arrays_zip(x.alias("x"), first.alias("v")), field, lambda s, f: 0.5 * (s["v"] + _velocity(s["x"] + 0.5 * dt * s["v"], f, mass)))
        return both

    def moved(state: Column) -> Column:
        def with_velocity(v: Column) -> Column:
            after = F.zip_with(state["x"], v, lambda x, y: F.greatest(F.lit(0.0), F.least(F.lit(10.0), x + dt * y)))

            def with_state(x: Column) -> Column:
                distance = F.sqrt(_sum(F.zip_with(x, field, lambda y, f: (y - f["a"]) * (y - f["a"]))))
                step = F.sqrt(_sum(F.zip_with(x, state["x"], lambda y, z: (y - z) * (y - z))))
                snap = F.struct(x.alias("state"), v.alias("velocity"), distance.alias("distance"), _sum(F.transform(v, lambda y: y * y)).alias("energy"))
                return F.struct(x.alias("x"), F.array_append(state["snaps"], snap).alias("snaps"), (step < STILL).alias("done"))

            return let(after, with_state)

        return let(velocities(state["x"]), with_velocity)

    kind = "array<struct<state:array<double>,velocity:array<double>,distance:double,energy:double>>"
    begin = F.struct(F.col("_x").alias("x"), F.array().cast(kind).alias("snaps"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), begin, lambda s, _: F.when(s["done"], s).otherwise(moved(s)))
    rows = rows.withColumn("_e", end)
    return rows.withColumns({"snapshots": F.col("_e.snaps"), "stabilized": F.col("_e.done")}).drop("_x", "_h", "_s", "_f", "_m", "_e")
