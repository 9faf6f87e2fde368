"""Memory of cluster contexts: how often and when each was seen, what it is worth, and which ones are forgotten.

Contexts are a table (owner, context, last_seen, hits, importance, fixed), fixed being an importance that was set.  An
owner holds at most `most` contexts.  A step is a merge with the contexts seen in it, so one busy owner is split like any
other key, and a stream's micro-batch is a step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

# Contexts an owner holds, steps that halve what they are worth, gain by hits, what is forgotten at once.
MOST, HALF_LIFE, BY_HITS, FLOOR = 128, 40.0, 0.25, 0.05

SCHEMA = "owner string, context string, last_seen long, hits long, importance double, fixed double"


def fresh(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def importance(clusters: Column, impact: Column) -> Column:
    """Of a context with so many clusters and such a mean absolute impact; one without clusters is worth 1."""
    return F.when(F.coalesce(clusters, F.lit(0)) == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 0.8 + 0.15 * clusters + 0.1 * F.coalesce(impact, F.lit(0.0))))


def retention(now: Column) -> Column:
    age = F.greatest(F.lit(0.0), (now - F.col("last_seen")).cast("double"))
    return F.greatest(F.lit(0.0), F.col("importance") * F.exp(-math.log(2.0) * age / HALF_LIFE) * (1 + BY_HITS * F.log1p(F.greatest(F.lit(0), F.col("hits")))))


def evicted(contexts: DataFrame, now: Column, most: int = MOST) -> DataFrame:
    """The contexts with `retention` and `gone`: those below the floor, and of an owner's others all but the `most` that are
    worth most (ties: the smaller name stays)."""
    rows = contexts.withColumn("retention", retention(now))
    fit = rows.where(F.col("retention") >= FLOOR).select("owner", "context", "retention")
    order = Window.partitionBy("owner").orderBy(F.desc("retention"), "context")
    kept = fit.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("owner", "context", F.lit(False).alias("gone"))
    return rows.join(kept, ["owner", "context"], "left").withColumn("gone", F.coalesce("gone", F.lit(True)))


def remembered(contexts: DataFrame, seen: DataFrame, now: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(contexts, owners) after a step.  seen: owner, context, clusters, impact; a context that is seen several times in a
    step is one hit, by its last row in the order of clusters and impact.  Rows count at the step they come in, however
    late they are; null and blank names are no contexts.  Eviction goes over all owners seen in the step; owners: owner,
    active, evicted."""
    name = F.trim(F.col("context"))
    once = seen.where(name != "").where("owner is not null").groupBy("owner", name.alias("context")).agg(F.max(F.struct("clusters", "impact")).alias("s"))
    worth = importance(F.col("s.clusters"), F.col("s.impact"))
    once = once.select("owner", "context", worth.alias("worth"))
    rows = contexts.join(once, ["owner", "context"], "full_outer")
    hit = F.col("worth").isNotNull()
    rows = saved(rows.select(
        "owner", "context", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("last_seen")).alias("last_seen"), (F.coalesce("hits", F.lit(0).cast("long")) + hit.cast("long")).alias("hits"),
        F.when(hit, F.coalesce("fixed", "worth")).otherwise(F.col("importance")).alias("importance"), "fixed",
    ))
    live = once.select("owner").distinct()
    held = rows.where("hits > 0")
    judged = evicted(held.join(live, "owner", "left_semi"), F.lit(now), most)
    judged = saved(judged)
    # what is only known by an importance set beforehand, and the contexts of other owners, stay as they are
    rest = rows.where("hits = 0").unionByName(held.join(live, "owner", "left_anti"))
    owners = judged.groupBy("owner").agg(F.count_if(~F.col("gone")).alias("active"), F.count_if("gone").alias("evicted"))
    return saved(judged.where("not gone").drop("retention", "gone").unionByName(rest)), owners


def cleared(contexts: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the contexts (owner, context) of a list, blanks around a name left out."""
    return contexts.join(gone.select("owner", F.trim("context").alias("context")), ["owner", "context"], "left_anti")


def valued(contexts: DataFrame, fixed: DataFrame) -> DataFrame:
    """With the importance (owner, context, value) set, 0.01 at least, from the next time the context is seen; a context
    that is not known yet keeps it until then.  Blank names are passed over; of several values the largest holds."""
    given = fixed.where(F.trim("context") != "").groupBy("owner", F.trim("context").alias("context")).agg(F.greatest(F.lit(0.01), F.max("value").cast("double")).alias("value"))
    rows = contexts.join(given, ["owner", "context"], "full_outer")
    return rows.select("owner", "context", F.coalesce("last_seen", F.lit(0).cast("long")).alias("last_seen"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), F.coalesce("importance", "value").alias("importance"), F.coalesce("value", "fixed").alias("fixed"))


class Keeper:
    """Keeps the memory of a stream: `stream.writeStream.foreachBatch(keeper)`.  Each micro-batch is a step, numbered by the
    batch, so a batch that is run again after a failure gives what it gave before; its version is written once."""

    def __init__(self, spark: SparkSession, folder: str, most: int = MOST):
        self.spark, self.folder, self.most = spark, folder, most

    def _path(self, step: int) -> str:
        return f"{self.folder}/step={step}"

    def at(self, step: int) -> DataFrame:
        """The contexts after a batch; none before the first."""
        return self.spark.read.schema(SCHEMA).parquet(self._path(step)) if step >= 0 else fresh(self.spark)

    def __call__(self, batch: DataFrame, step: int) -> None:
        after, _ = remembered(self.at(step - 1), batch, step + 1, self.most)
        after.write.mode("overwrite").parquet(self._path(step))
