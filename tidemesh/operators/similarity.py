"""Nearest vectors of a stated query set, and measures of values over given clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A part holds about so many bytes of vectors, a block so many queries.
PART_BYTES, BLOCK_QUERIES = 16 << 20, 4096


def cosine_topk(queries: DataFrame, vectors: DataFrame, item: str, vector: str, k: int, blocks: int | None = None, parts: int | None = None) -> DataFrame:
    """(query, item, score, rank): the k nearest other rows of each row of a stated query set, by exact cosine to nine
    decimals, ties by id.  Queries lie in `blocks`, rows in `parts`, by default as many as keep each small; each block meets
    each part once, as matrices, and gives what can be among the k nearest before the shuffle.  A score is null where the
    lengths differ or a component is null, and comes last."""
    if blocks is None:
        blocks = -(-queries.count() // BLOCK_QUERIES) or 1
    if parts is None:
        size = vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
        parts = max(8, -(-size.n * 8 * max(1, size.width or 1) // PART_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    single = all(d.schema[vector].dataType.simpleString() == "array<float>" for d in (queries, vectors))
    own = lambda d: d.where(F.col(vector).isNotNull()).select(F.col(item).alias("item"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    q = own(queries).select("*", F.lit(True).alias("asks"), dealt(blocks).alias("block"), every(parts).alias("part"))
    rows = own(vectors).select("*", F.lit(False).alias("asks"), dealt(parts).alias("part"), every(blocks).alias("block"))
    # few bytes and much work: as many tasks as pairs
    grid = q.unionByName(rows).where("item is not null").repartition(blocks * parts, "block", "part")
    kind = grid.schema["item"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids = table.column("item").combine_chunks()
        for ask, row, score in nearest(table.column("v").combine_chunks(), table.column("asks").to_numpy(), pc.rank(ids, tiebreaker="dense").to_numpy(), k):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(ask)), ids.take(pa.array(row)), score], ["query", "item", "score"])

    found = grid.groupBy("block", "part").applyInArrow(compare, f"query {kind}, item {kind}, score double").withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: pa.ListArray, asks: np.ndarray, order: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(place of a query, place of a row, score): what can be among the k nearest of each query, ids being in the given order.

    Vectors are brought to length 1.  Matrix products choose by a margin that is wider than their error and than the rounding of scores; the scores of what
    they choose are summed component by component, as a plain expression does.  Of equal scores the k smallest ids are kept."""
    width, values = np.diff(vectors.offsets.to_numpy()), vectors.flatten()
    start = np.cumsum(width) - width
    gaps = np.add.reduceat(np.append(values.is_null().to_numpy(zero_copy_only=False), False).astype(np.int64), start) if len(start) else start
    width = np.where((width > 0) & (gaps > 0), -1, width)  # a null makes every score null
    values = values.to_numpy(zero_copy_only=False)
    for w in np.unique(width[asks]):
        q, rows = np.flatnonzero(asks & (width == w)), np.flatnonzero(~asks & (width == w) & (w >= 0))
        rest = np.flatnonzero(~asks & ((width != w) | (w < 0)))
        rest = rest[np.argsort(order[rest], kind="stable")][: k + 1 if len(np.unique(order[rest])) == len(rest) else None]
        few, many = (_unit(values[start[x][:, None] + np.arange(max(w, 0))].astype(np.float64)) for x in (q, rows))
        step = max(1, (4 << 20) // max(1, len(rows)))
        for at in range(0, len(q), step):
            own = q[at : at + step]
            with np.errstate(all="ignore"):
                near = few[at : at + step] @ many.T
            near[np.isnan(near)] = np.inf  # the largest, as in an ordering
            near[order[own][:, None] == order[rows]] = -np.inf
            least = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(own), -np.inf)
            left, right = np.nonzero((near >= least[:, None] - 1e-8) & (near > -np.inf))
            score = np.zeros(len(left))
            for d in range(max(w, 0)):
                score += few[at + left, d] * many[right, d]
            rank = np.where(np.isnan(score), np.inf, score)
            by = np.lexsort((order[rows[right]], -rank, left))
            left, right, score, rank = left[by], right[by], score[by], rank[by]
            new = np.append(True, (left[1:] != left[:-1]) | (rank[1:] != rank[:-1]))[: len(left)]
            keep = np.arange(len(left)) - np.maximum.accumulate(np.where(new, np.arange(len(left)), 0)) < k
            yield own[left[keep]], rows[right[keep]], pa.array(score[keep], pa.float64())
            for i in np.flatnonzero(np.bincount(left, minlength=len(own)) < k) if len(rest) else ():
                other = rest[order[rest] != order[own[i]]][:k]
                yield np.full(len(other), own[i]), other, pa.nulls(len(other), pa.float64())


def _unit(rows: np.ndarray) -> np.ndarray:
    square = np.zeros(len(rows))
    with np.errstate(all="ignore"):
        for d in range(rows.shape[1]):
            square += rows[:, d] * rows[:, d]
        return rows / (np.sqrt(square) + 1e-12)[:, None]


def cross_scale(values: DataFrame) -> DataFrame:
    """(cluster, n, score): how far the values of a cluster agree in sign and size, from (cluster, value)."""
    agg = values.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.abs("value")).alias("absolute"), F.var_pop("value").alias("var"))
    mean = F.col("absolute") / F.col("n")
    score = 0.55 * F.abs("total") / F.col("absolute") + 0.45 / (1 + F.col("var") / (mean * mean + 1e-9))
    return agg.select("cluster", "n", F.when(F.col("absolute") <= 1e-12, 1.0).otherwise(score).alias("score"))


def margin(values: DataFrame) -> DataFrame:
    """One row: how far the largest cluster mean stands above the second (0 where there is none)."""
    means = values.groupBy("cluster").agg(F.avg("value").alias("m")).orderBy(F.desc("m")).limit(2)
    two = means.agg(F.max("m").alias("t1"), F.when(F.count("*") > 1, F.min("m")).otherwise(0.0).alias("t2"))
    share = (F.col("t1") - F.col("t2")) / (F.abs("t1") + F.abs("t2") + 1e-9)
    return two.select(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("margin"))
