"""Measures of ordered series, one series a run: windows within a run, then one aggregation.

Functions with a `block` cut long runs at it (see `ordered`); it changes the work, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried, number, own, upto, whole


def _by(run: str, order: list[str]):
    return Window.partitionBy(run).orderBy(*order)


def transitions(labels: DataFrame, run: str, order: list[str], block: Column | None = None) -> DataFrame:
    """(src, dst, n, total): consecutive labels of all runs; n / total is a row of the stochastic matrix."""
    rows, w = carried(labels.select(run, *order, "label"), [run], order, block, last=("label",))
    steps = own(rows.withColumns({"i": number(w), "src": F.lag("label").over(w)})).where("i > 1 and label is not null").select("src", F.col("label").alias("dst"))
    counts = steps.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("src")))


def dominant(labels: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Each run's most frequent label, the first seen of equal ones."""
    seen = labels.groupBy(run, "label").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("n"), "first"))
    return seen.withColumn("r", rank).where("r = 1").select(run, "label", "n")


def persistence(labels: DataFrame, run: str, order: list[str], block: Column | None = None) -> DataFrame:
    """Longest stretch of one label, the label changes, and the length of each run."""
    rows, w = carried(labels.select(run, *order, "label"), [run], order, block, last=("label",))
    marked = rows.withColumn("new", F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(0))).where("_mark = 1").drop("_mark", "_before")
    rows, w = carried(marked, [run], order, F.col("_block"), sums=("new",))
    island = own(rows.withColumn("island", F.sum("new").over(upto(w))))
    runs = island.groupBy(run, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(run).agg(F.max("n").alias("longest"), F.sum("n").alias("length"), (F.count("*") - 1).alias("switches"))


def flips(series: DataFrame, run: str, order: list[str], value: str = "x", eps: float = 1e-9, block: Column | None = None) -> DataFrame:
    """Changes of direction: steps within eps are passed over.  (flips, chances, n)"""
    rows, w = carried(series.select(run, *order, F.col(value).alias("x")), [run], order, block, last=("x",))
    steps = rows.withColumn("d", F.col("x") - F.lag("x").over(w)).where("_mark = 1").drop("_mark", "_before")
    rows, w = carried(steps.where(F.abs("d") > eps).withColumn("s", F.signum("d")), [run], order, F.col("_block"), last=("s",))
    moved = own(rows.withColumn("turned", (F.col("s") != F.lag("s").over(w)).cast("int")))
    count = moved.groupBy(run).agg(F.coalesce(F.sum("turned"), F.lit(0)).alias("flips"), (F.count("*") - 1).alias("chances"))
    return series.groupBy(run).agg(F.count("*").alias("n")).join(count, run, "left").fillna(0, ["flips", "chances"])


def resilience(series: DataFrame, run: str, order: list[str], value: str = "x", block: Column | None = None) -> DataFrame:
    """First and last value, first step at or under half of the first, overshoot, settling step and path length."""
    rows, w = carried(series.select(run, *order, F.col(value).alias("x")), [run], order, block, last=("x",), ends="x")
    rows = own(rows.withColumns({"i": number(w), "first": whole("_first", w), "last": whole("_last", w), "step": F.abs(F.col("x") - F.lag("x").over(w))}))
    far = F.abs(F.col("x") - F.col("last")) > F.greatest(F.lit(1e-6), F.abs("last") * 0.05)
    return rows.groupBy(run).agg(
        F.count("*").alias("n"), F.first("first").alias("first_value"), F.first("last").alias("last_value"),
        F.coalesce(F.min(F.when(F.col("x") <= F.col("first") / 2, F.col("i"))), F.count("*")).alias("recovery_steps"),
        F.greatest(F.lit(0.0), F.max("x") - F.first("first")).alias("overshoot"), (F.coalesce(F.max(F.when(far, F.col("i"))), F.lit(0)) + 1).cast("int").alias("settling"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"),
    )


def recovery(measured: DataFrame, run: str) -> DataFrame:
    """(rate, efficiency) from what `resilience` returns: how far the first value was left, and direct over walked way."""
    first, last = F.col("first_value"), F.col("last_value")
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (first - last) / F.greatest(F.lit(1e-6), F.abs(first))))
    straight = F.when((F.col("n") < 2) | (F.col("path") <= 1e-9), 1.0).otherwise(F.least(F.lit(1.0), F.abs(first - last) / F.col("path")))
    return measured.select(run, rate.alias("rate"), straight.alias("efficiency"))


def hysteresis(forward: DataFrame, backward: DataFrame, run: str, step: str) -> DataFrame:
    """(run, hysteresis): mean absolute difference of two series (run, step, x) over the steps both have."""
    both = forward.select(run, step, F.col("x").alias("a")).join(backward.select(run, step, F.col("x").alias("b")), [run, step])
    return both.groupBy(run).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("hysteresis"))


def quantile_radius(distances: DataFrame, run: str, q: float) -> DataFrame:
    """(run, radius): the distance at the nearest rank (n - 1) q, halves to even.  Equal distances are counted first; a run's
    buckets, 64 to a doubling, then tell which of them holds the rank, and only its distances are ordered."""
    d = F.col("d").cast("double")
    bucket = F.when(F.isnan(d), F.lit(1 << 40)).when(d > 0, F.floor(F.log2(d) * 64)).otherwise(F.lit(-(1 << 40)))
    values = distances.groupBy(run, bucket.alias("bucket"), "d").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(run).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = values.groupBy(run, "bucket").agg(F.sum("n").alias("n")).withColumns({"before": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(run))})
    rank = F.rint((F.col("all") - 1) * q) + 1
    held = counts.where((F.col("before") < rank) & (rank <= F.col("before") + F.col("n"))).select(F.col(run).alias("_run"), F.col("bucket").alias("_bucket"), (rank - F.col("before")).alias("rank"))
    rows = values.join(held, F.col(run).eqNullSafe(F.col("_run")) & (F.col("bucket") == F.col("_bucket")))
    upto_d = Window.partitionBy("_run", "_bucket").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n").over(upto_d))
    return rows.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(run, F.col("d").alias("radius"))


def state_class(regularity: Column, speed: Column, density: Column) -> Column:
    return F.when((regularity >= 0.7) & (speed <= 0.5), "stable_routine").when((speed >= 0.7) | (density >= 6), "high_flux").otherwise("adaptive")


def regime(order: Column) -> Column:
    return F.when(order < 0.33, "calm").when(order < 0.66, "adaptive").otherwise("turbulent")


def phase(series: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Order parameter of each step from speed, dist and tension, each min-max normalised in its run, its regime, and
    the rolling variance of three steps."""
    whole = Window.partitionBy(run)

    def normal(c: str) -> Column:
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        return F.when(high - low <= 1e-9, 0.0).otherwise((F.col(c) - low) / (high - low))

    rows = series.select(run, *order, (0.45 * normal("speed") + 0.35 * normal("dist") + 0.20 * normal("tension")).alias("order_parameter"))
    w = _by(run, order)
    return rows.withColumns({"regime": regime(F.col("order_parameter")), "change": F.col("order_parameter") - F.lag("order_parameter").over(w), "rolling": F.var_pop("order_parameter").over(w.rowsBetween(-2, 0))})


def slowing(series: DataFrame, run: str, order: list[str], value: str = "x", block: Column | None = None) -> DataFrame:
    """(n, autocorrelation, slowing): lag-1 correlation mapped to 0..1 (0 where it has none), and its mix with the rise
    of the rolling variance of three steps; 0 for fewer than three steps."""
    rows, w = carried(series.select(run, *order, F.col(value).cast("double").alias("x")), [run], order, block, last=("x",))
    rows = rows.withColumns({"y": F.lag("x").over(w), "i": number(w)}).where("_mark = 1").drop("_mark", "_before")
    rows, w = carried(rows, [run], order, F.col("_block"), last=("y",))
    three = F.array_compact(F.array("x", "y", F.lag("y").over(w)))
    total = lambda f: F.aggregate(three, F.lit(0.0), lambda a, x: a + f(x))
    rows = rows.withColumn("mean", F.try_divide(total(lambda x: x), F.size(three)))
    rows = own(rows.withColumn("rolling", F.try_divide(total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.size(three))))
    late = F.when(F.col("i") >= 3, F.col("i"))
    agg = rows.groupBy(run).agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), F.var_pop(F.when(F.col("y").isNotNull(), F.col("x"))).alias("vx"), F.var_pop("y").alias("vy"),
        F.min_by("rolling", late).alias("first"), F.max_by("rolling", late).alias("last"),
    )
    spread = F.sqrt(F.col("vx") * F.col("vy"))
    flat = spread * (F.col("n") - 1) <= 1e-9
    auto = F.when((F.col("n") < 3) | flat, 0.0).otherwise((F.try_divide("cov", spread) + 1) / 2)
    trend = F.when(F.col("n") == 3, F.col("last")).otherwise(F.greatest(F.lit(0.0), F.col("last") - F.col("first")))
    mixed = F.least(F.lit(1.0), 0.65 * auto + 0.35 * F.least(F.lit(1.0), 4 * trend))
    return agg.select(run, "n", auto.alias("autocorrelation"), F.when(F.col("n") < 3, 0.0).otherwise(mixed).alias("slowing"))


def triggers(states: DataFrame, run: str, order: list[str]) -> DataFrame:
    """One row at each change of `label`: the reasons among speed, regularity and density, and a confidence from 0 to 1."""
    w = _by(run, order)
    up = lambda c: F.col(c) - F.lag(c).over(w)
    rows = states.select(run, *order, "label", F.lag("label").over(w).alias("was"), up("speed").alias("speed"), (-up("regularity")).alias("drop"), up("density").alias("density"))
    reasons = F.array_compact(F.array(F.when(F.col("speed") > 0.15, "speed_jump"), F.when(F.col("drop") > 0.15, "regularity_drop"), F.when(F.col("density") > 0.5, "density_jump")))
    rise = lambda c: F.greatest(F.lit(0.0), F.col(c))
    confidence = F.least(F.lit(1.0), 1.8 * rise("speed") + 1.6 * rise("drop") + 0.6 * rise("density"))
    text = F.when(F.size(reasons) == 0, "state_boundary_crossed").otherwise(F.array_join(reasons, ","))
    return rows.where("label <> was").select(run, *order, "was", "label", text.alias("reasons"), confidence.alias("confidence"))


def basin(states: DataFrame, run: str, order: list[str], features: list[str]) -> DataFrame:
    """(radius, occupancy): mean plus deviation of the distances of the dominant label's points to their centre, and the
    share of all points within it (to 1e-9)."""
    main = dominant(states, run, order).select(run, F.col("label").alias("main"))
    points = states.select(run, "label", *features).join(main, run)
    inside = F.col("label") == F.col("main")
    centre = points.groupBy(run).agg(*[F.avg(F.when(inside, F.col(f))).alias("c_" + f) for f in features])
    far = points.join(centre, run).withColumn("d", F.sqrt(sum((F.pow(F.col(f) - F.col("c_" + f), 2) for f in features), F.lit(0.0))))
    near = F.when(inside, F.col("d"))
    radius = far.groupBy(run).agg((F.avg(near) + F.stddev_pop(near)).alias("radius"))
    return far.join(radius, run).groupBy(run).agg(F.first("radius").alias("radius"), F.avg((F.col("d") <= F.col("radius") + 1e-9).cast("double")).alias("occupancy"))


def alignment(states: DataFrame, run: str, order: list[str], shock: dict[str, float], lag: int = 1) -> DataFrame:
    """Share of the shock's weight whose feature moved its way between step `lag` and the last one."""
    whole = Window.partitionBy(run)
    rows = states.select(run, *shock, F.row_number().over(_by(run, order)).alias("i"), F.count("*").over(whole).alias("n"))
    start = F.col("i") == F.least(F.col("n"), F.lit(lag + 1))
    ends = rows.groupBy(run).agg(*[(F.max(F.when(F.col("i") == F.col("n"), F.col(f))) - F.max(F.when(start, F.col(f)))).alias(f) for f in shock])
    used = {f: s for f, s in shock.items() if abs(s) >= 1e-9}
    hit = sum((F.when(F.col(f) * s > 0, abs(s)).otherwise(0.0) for f, s in used.items()), F.lit(0.0))
    return ends.select(run, (hit / max(1e-9, sum(map(abs, used.values())))).alias("aligned"))
