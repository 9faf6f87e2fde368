"""Windows over long ordered runs, a block at a time.

A window over a run puts the run in one task.  Here a run is cut into blocks (days, say), and each block gets one row more,
before its own, that holds what it has to know of the rows before it: the last values, sums and maxima so far.  That row is
made from one aggregate a block, so no task sees more than a block of rows or the list of a run's blocks, and a window over
run and block gives what one over the whole run would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def carried(rows: DataFrame, run: list[str], order: list[str], block: Column | None = None, last: tuple[str, ...] = (), sums: tuple[str, ...] = (), maxima: tuple[str, ...] = (), ends: str | None = None) -> tuple[DataFrame, WindowSpec]:
    """(rows with the carried ones, a window over them); the carried rows have _mark 0 and go when the windows are done.

    block must not fall in the order of a run; null comes first, and without a block a run is one.  A carried row holds, in
    the columns of `last`, the values of the row before the block, in those of `sums` and `maxima` the sum and the maximum
    of all rows before it; its other columns are null.  _before counts the rows before the block, and of the column `ends`
    _first and _last are the first and last values of the whole run.  A null run is a run."""
    at = F.struct(*order)
    dealt = rows.withColumn("_block", F.lit(0) if block is None else block)
    told = [F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums], *[F.max(c).alias(f"_max_{c}") for c in maxima]]
    told += [F.max_by(F.struct(*last), at).alias("_end")] if last else []
    told += [F.min_by(ends, at).alias("_first"), F.max_by(ends, at).alias("_last")] if ends else []
    w = Window.partitionBy(*run).orderBy("_block")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marks = dealt.groupBy(*run, "_block").agg(*told)
    marks = marks.select(
        *run, "_block", F.lit(0).alias("_mark"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *([F.lag("_end").over(w).alias("_end")] if last else []), *[F.sum(f"_sum_{c}").over(before).alias(c) for c in sums],
        *[F.max(f"_max_{c}").over(before).alias(c) for c in maxima], *([F.first("_first").over(whole).alias("_first"), F.last("_last").over(whole).alias("_last")] if ends else []),
    )
    marks = marks.withColumns({c: F.col(f"_end.{c}") for c in last}).drop("_end") if last else marks
    inner = Window.partitionBy(*run, "_block").orderBy("_mark", *order)
    return dealt.withColumn("_mark", F.lit(1)).unionByName(marks, allowMissingColumns=True), inner


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def number(w: WindowSpec) -> Column:
    """The number of a row in its run, from 1."""
    return F.first("_before").over(upto(w)) + F.sum("_mark").over(upto(w))


def whole(name: str, w: WindowSpec) -> Column:
    """What the carried row says for the whole run: `_first` or `_last`."""
    return F.first(name).over(upto(w))


def own(rows: DataFrame) -> DataFrame:
    """The rows without the carried ones."""
    return rows.where("_mark = 1").drop("_mark", "_before", "_block")
