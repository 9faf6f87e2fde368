"""Operator 9: embedding near-dedup by an exact metric range join.

Vectors of length 1 with cosine c are sqrt(2 - 2c) apart, so cosine >= 0.9 is a range join.  Pivots, a bounded
sample of the vectors, cut the space into cells: a vector lies in the cell of its nearest pivot, and large cells in
several blocks.  Each two blocks are joined once.  A vector goes to the pair of its block with another only where the
triangle inequality leaves a partner there: two vectors on different sides of the plane between two pivots are at
least as far apart as their distances from the plane together.  So it stays away where its own distance and the
smallest in the other block exceed the range, and a pair that nothing goes to is never made.

Where distances hardly differ (independent directions in many dimensions) this excludes little, and the join compares
nearly all pairs of blocks; it stays exact.  Blocks are compared in single precision with a margin; what lies inside
the margin is decided in double precision.

Defined results: null or zero vectors, and those with a null or non-finite component, have no links and are components
of their own; shorter vectors count as filled with zeros; equal vectors are joined as one with a count; rows that
repeat an id count as vectors of their own; vectors with a null id link like others, but never name a component while
another id is in it; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, local_labels, saved, scratch


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    #: At most so many vectors are pivots, those with the smallest hash of their id.
    pivots: int = 8
    #: A block holds about so many bytes of vectors, in double precision, at most ...
    block_bytes: int = 32 << 20
    #: ... and there are about so many blocks at least, of at least so many rows, so that small tables use all cores.
    least_blocks: int = 8
    least_rows: int = 1024


def usable(v: Column) -> Column:
    """No null, no component that is null or not finite, and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length 1 in double precision, filled with zeros to the width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def cells_of(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, distance from the plane between the home pivot and each pivot, 0 for the home pivot itself)."""
    square = np.maximum(0, 2 - 2 * unit @ pivots.T)
    home = square.argmin(axis=1)
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    plane = (square - square[np.arange(len(unit)), home][:, None]) / np.maximum(2 * between, 1e-12)
    plane[np.arange(len(unit)), home] = 0
    return home, plane


def block_links(home: np.ndarray, every: np.ndarray, cosine: float):
    """Index pairs (home row, row) with cosine >= the limit, for slices of the home rows."""
    few, many = home.astype(np.float32), every.astype(np.float32)
    for at in range(0, len(home), 512):
        near = few[at : at + 512] @ many.T
        left, right = np.nonzero(near >= cosine - 1e-4)
        unsure = np.flatnonzero(near[left, right] < cosine + 1e-4)
        good = np.ones(len(left), bool)
        for k in range(0, len(unsure), 50_000):
            u = unsure[k : k + 50_000]
            good[u] = np.einsum("ij,ij->i", home[at + left[u]], every[right[u]]) >= cosine
        yield at + left[good], right[good]


def near(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a vector."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = own.where(usable(F.col("v")))
    with scratch() as tables:
        # the number of a distinct vector is part of the written table, so it never changes
        distinct = saved(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
        width = distinct.agg(F.max(F.size("v"))).first()[0]
        if width is None:
            return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        found = saved(_links(distinct, width, s))
        parts = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
        counts = found.groupBy("node").agg(F.sum("n").alias("n"))
        classes = distinct.join(counts, "node", "left").join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
        names = classes.groupBy("label").agg(F.min("rep").alias("name"))
        classes = classes.join(names, "label").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "name")
        classes = tables.keep(saved(classes))
    rows = own.select("vec_id", F.when(usable(F.col("v")), F.col("v")).alias("v")).join(classes, "v", "left")
    component = F.coalesce("name", "vec_id")
    return rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(distinct: DataFrame, width: int, s: Settings) -> DataFrame:
    """(node, low, n): links that a node has in one pair of blocks, and a node that all those it reaches there tell."""
    sample = distinct.orderBy(F.xxhash64("rep", "node"), "node").limit(s.pivots).select("v").collect()
    pivots = np.unique(_matrix(pa.array([r.v for r in sample], pa.list_(pa.float64())), width), axis=0)
    reach = float(np.sqrt(2 - 2 * s.cosine)) + 1e-9

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                home, plane = cells_of(_matrix(batch.column(0), width), pivots)
                planes = pa.FixedSizeListArray.from_arrays(pa.array(plane.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), planes], ["v", "node", "copies", "cell", "plane"])

    kind = distinct.schema["v"].dataType.simpleString()
    placed = saved(distinct.select("v", "node", "copies").mapInArrow(place, f"v {kind}, node long, copies long, cell int, plane array<double>"))
    # From here to `pairs` there is a row a cell, a block or a pair of blocks.
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most as many as pivots
    rows = max(1, min(s.block_bytes // (8 * width), max(s.least_rows, -(-sum(sizes.values()) // s.least_blocks))))
    parts = {c: -(-n // rows) for c, n in sorted(sizes.items())}
    first, blocks = {}, 0
    for c, n in parts.items():
        first[c], blocks = blocks, blocks + n
    at = lambda known: F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("cell"))
    dealt = placed.withColumn("block", (at(first) + F.pmod(F.xxhash64("node"), at(parts))).cast("int"))
    nearest = dealt.groupBy("block", "cell").agg(F.array(*[F.min(F.col("plane")[k]) for k in range(len(pivots))]).alias("least"))
    one = nearest.select(F.col("block").alias("i"), F.col("cell").alias("cell_i"), F.col("least").alias("least_i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"))
    two = nearest.select(F.col("block").alias("j"), F.col("cell").alias("cell_j"), F.col("least").alias("least_j"))
    pairs = one.join(two, "j").where(F.col("least_i")[F.col("cell_j")] + F.col("least_j")[F.col("cell_i")] <= reach)
    # Each row goes to the pairs of its block; how far the other block comes to the plane is told by the pair.
    ends = F.array(
        F.struct(F.col("i").alias("block"), F.lit(0).alias("side"), F.col("cell_j").alias("other"), F.col("least_j")[F.col("cell_i")].alias("gap")),
        F.struct(F.col("j").alias("block"), F.lit(1).alias("side"), F.col("cell_i").alias("other"), F.col("least_i")[F.col("cell_j")].alias("gap")),
    )
    ends = pairs.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.slice(ends, 1, 1)).otherwise(ends)).alias("e")).select("i", "j", "e.*")
    grid = dealt.join(ends, "block").where(F.col("plane")[F.col("other")] + F.col("gap") <= reach).select("i", "j", "side", "node", "copies", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        node, copies, side = (table.column(c).to_numpy() for c in ("node", "copies", "side"))
        unit = _matrix(table.column("v"), width)
        within = table.column("i")[0] == table.column("j")[0]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1))
        links = np.zeros(len(node), np.int64)
        labels = np.arange(len(node))
        if len(left) and len(right):
            for one, two in block_links(unit[left], unit[right], s.cosine):
                one, two = left[one], right[two]
                apart = one < two if within else one != two
                one, two = one[apart], two[apart]
                np.add.at(links, one, copies[two]), np.add.at(links, two, copies[one])
                labels = local_labels(len(node), np.concatenate([np.arange(len(node)), one]), np.concatenate([labels, two]))
        tell = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[tell]), pa.array(node[labels[tell]]), pa.array(links[tell])], ["node", "low", "n"])

    return grid.groupBy("i", "j").applyInArrow(compare, "node long, low long, n long")
