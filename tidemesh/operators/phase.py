"""Phase analysis of runs: all measures of a run from one window stage and three aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import regime

EPS = 1e-9


def unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def padded(series: DataFrame, run: str, order: list[str], columns: list[str]) -> DataFrame:
    """Missing values repeat the last one of the run before them; 0 where there is none."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in columns})


def _steps(series: DataFrame, run: str, order: list[str]) -> DataFrame:
    whole = Window.partitionBy(run)
    w = whole.orderBy("at")

    def normal(c: str) -> Column:
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        return F.when(high - low <= EPS, 0.0).otherwise((F.col(c) - low) / (high - low))

    rows = series.select(run, F.struct(*order).alias("at"), *[normal(c).alias(c) for c in ("speed", "dist", "tension", "objective")])
    rows = rows.withColumn("x", 0.45 * F.col("speed") + 0.35 * F.col("dist") + 0.2 * F.col("tension")).withColumn("regime", regime(F.col("x")))
    up = lambda c: F.col(c) - F.lag(c).over(w)
    rows = rows.select(
        run, "at", "x", "regime", "tension", F.row_number().over(w).alias("i"), F.lag("x").over(w).alias("y"), up("x").alias("d"), up("dist").alias("d_dist"), up("objective").alias("d_objective"),
        up("tension").alias("d_tension"), F.var_pop("x").over(w.rowsBetween(-2, 0)).alias("rolling"), F.coalesce((F.col("regime") != F.lag("regime").over(w)).cast("int"), F.lit(0)).alias("new"),
    )
    sign = F.when(F.col("d") > EPS, 1).when(F.col("d") < -EPS, -1)
    rows = rows.withColumn("sign", sign)
    before = F.last("sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"before": before, "d_before": F.lag("d").over(w), "island": F.sum("new").over(w)})


def analysis(series: DataFrame, run: str, order: list[str]) -> DataFrame:
    """One row a run of (speed, dist, tension, objective): n, switches, persistence, flip_rate, coherence, break, hysteresis,
    slowing, critical, warning and the dominant regime, which is `critical` from a critical score of 0.6."""
    rows = _steps(series, run, order)
    moved = lambda c: F.when(F.abs(c) > EPS, F.signum(c))
    signs = [moved(F.col(c)) for c in ("d", "d_objective", "d_tension")]
    count = lambda s: sum((F.when(x == s, 1).otherwise(0) for x in signs), F.lit(0))
    agree = F.when(F.col("i") > 1, F.when(count(1) + count(-1) == 0, 1.0).otherwise(F.greatest(count(1), count(-1)) / (count(1) + count(-1))))
    late = F.when(F.col("i") >= 3, F.col("i"))
    both = F.col("y").isNotNull()
    agg = rows.groupBy(run).agg(
        F.count("*").alias("n"), F.sum("new").alias("switches"), F.max(F.abs("d")).alias("jump"), F.var_pop("x").alias("variance"), F.avg(F.abs("d_objective")).alias("moves"),
        F.covar_pop("x", "y").alias("cov"), F.var_pop(F.when(both, F.col("x"))).alias("vx"), F.var_pop("y").alias("vy"), F.min_by("rolling", late).alias("first"), F.max_by("rolling", late).alias("last"),
        F.avg((F.col("d") * F.col("d_objective") < 0).cast("double")).alias("against"), F.count_if(F.col("sign").isNotNull() & F.col("before").isNotNull()).alias("chances"), F.count_if(F.col("sign") != F.col("before")).alias("flips"),
        F.avg(agree).alias("agree"), (F.count_if(F.col("d_dist") * F.col("d_objective") < 0) + 0.5 * F.count_if(F.col("d_objective") * F.col("d_tension") < 0)).alias("mismatch"),
        F.max_by(F.greatest(F.abs("d"), F.abs("d_before")), "i").alias("recent"), F.max_by("tension", "i").alias("tension"),
    )
    islands = rows.groupBy(run, "island", "regime").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    labels = islands.groupBy(run, "regime").agg(F.sum("n").alias("n"), F.max("n").alias("longest"), F.min("i").alias("i"))
    most = labels.groupBy(run).agg(F.max("longest").alias("longest"), F.max(F.struct("n", -F.col("i"), "regime")).alias("most"))
    rows = agg.join(most.select(run, "longest", F.col("most.n").alias("share"), F.col("most.regime").alias("main")), run)
    spread = F.sqrt(F.col("vx") * F.col("vy"))
    auto = F.when((F.col("n") < 3) | (spread * (F.col("n") - 1) <= EPS), 0.0).otherwise((F.try_divide("cov", spread) + 1) / 2)
    trend = F.when(F.col("n") == 3, F.col("last")).otherwise(F.greatest(F.lit(0.0), F.col("last") - F.col("first")))
    few = F.col("n") < 3
    rows = rows.withColumns({
        "slowing": F.when(few, 0.0).otherwise(F.least(F.lit(1.0), 0.65 * auto + 0.35 * F.least(F.lit(1.0), 4 * trend))),
        "hysteresis": F.when(few, 0.0).otherwise(F.col("against")), "flip_rate": F.when(few | (F.col("chances") == 0), 0.0).otherwise(F.try_divide("flips", "chances")),
        "coherence": F.coalesce("agree", F.lit(1.0)), "broken": F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide("mismatch", 1.5 * (F.col("n") - 1)))),
        "persistence": 0.6 * F.col("longest") / F.col("n") + 0.4 * F.col("share") / F.col("n"), "local": F.when(few, F.col("variance")).otherwise(F.col("last")),
    })
    critical = unit(0.35 * F.coalesce("jump", F.lit(0.0)) + 0.19 * F.col("variance") + 0.14 * F.coalesce("moves", F.lit(0.0)) + 0.12 * F.col("slowing") + 0.08 * F.col("hysteresis") + 0.07 * F.col("flip_rate") + 0.05 * (1 - F.col("coherence")))
    above = lambda c, limit, gain: F.when(c > limit, gain).otherwise(0.0)
    recent = F.coalesce("recent", F.lit(0.0))
    warning = unit(
        above(recent, 0.12, F.least(F.lit(0.5), recent)) + above(F.col("local"), 0.03, F.least(F.lit(0.3), 2 * F.col("local"))) + above(F.col("tension"), 0.65, F.lit(0.2))
        + F.least(F.lit(0.15), 0.25 * F.col("flip_rate")) + F.least(F.lit(0.1), 0.2 * (1 - F.col("coherence")))
    )
    rows = rows.withColumns({"critical": critical, "warning": warning})
    label = F.when(F.col("critical") >= 0.6, "critical").otherwise(F.col("main"))
    return rows.select(run, "n", "switches", "persistence", "flip_rate", "coherence", "broken", "hysteresis", "slowing", "critical", "warning", label.alias("regime"))


def settled(series: DataFrame, run: str, order: list[str], distance: str, objective: str) -> DataFrame:
    """(run, flat, still): the last two steps of the objective were at most 0.01, the last step of the distance under 0.02."""
    w = Window.partitionBy(run).orderBy(*order)
    up = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    rows = series.select(run, F.row_number().over(w).alias("i"), up(distance).alias("d"), up(objective).alias("o")).withColumn("o_before", F.lag("o").over(Window.partitionBy(run).orderBy("i")))
    end = rows.groupBy(run).agg(F.max_by(F.struct("d", "o", "o_before"), "i").alias("e"))
    return end.select(run, F.coalesce((F.col("e.o") <= 0.01) & (F.col("e.o_before") <= 0.01), F.lit(False)).alias("flat"), F.coalesce(F.col("e.d") < 0.02, F.lit(False)).alias("still"))
