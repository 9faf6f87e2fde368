"""Contract checks over edges: every broken rule is a row, nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried, own


def issues(edges: DataFrame, nodes: DataFrame, low: float = 0.0, high: float = 5.0, graph_id: str = "graph", schema_version: str = "1", block: Column | None = None) -> DataFrame:
    """(code, edge_id): edges needs edge_id, ord, src, dst, layer, weight, ts; nodes needs id.  A graph without a name or a
    schema version has an issue without an edge.  Edges between the same ends are cut at `block`, which must not fall in
    the order of `ord`."""
    told = edges.select("edge_id", "ord", "src", "dst", "layer", "ts", (F.lit(0) if block is None else block).alias("_block"))
    rows, lane = carried(told, ["src", "dst", "layer"], ["ord"], F.col("_block"), maxima=("ts",))
    rows = own(rows.withColumn("late", F.max("ts").over(lane.rowsBetween(Window.unboundedPreceding, -1)) > F.col("ts")))
    late = rows.where("late").select(F.lit("timestamp_backwards").alias("code"), "edge_id")
    # every rule reads the edges by itself with the columns it needs; a name's repetitions are told by its count
    twins = edges.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1").select("edge_id", "n", F.explode(F.expr("sequence(0, (n - 2) div 1024)")).alias("k"))
    again = twins.select(F.lit("duplicate_interaction_id").alias("code"), "edge_id", F.explode(F.expr("sequence(k * 1024 + 2, least(n, k * 1024 + 1025))"))).select("code", "edge_id")
    known = nodes.select(F.col("id").alias("known")).distinct()
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("known"))
    dangling = ends.join(known, "known", "left_anti").select("edge_id").distinct().select(F.lit("dangling_edge_node").alias("code"), "edge_id")
    codes = F.array_compact(F.array(
        F.when(F.col("src") == F.col("dst"), "self_loop_not_allowed"), F.when((F.col("weight") < low) | (F.col("weight") > high), "weight_out_of_range"),
    ))
    found = edges.select(F.explode(codes).alias("code"), "edge_id").unionByName(again).unionByName(late).unionByName(dangling)
    for code, value in (("graph_id_missing", graph_id), ("schema_missing", schema_version)):
        if not value.strip():
            one = edges.sparkSession.range(1).select(F.lit(code).alias("code"), F.lit(None).cast(edges.schema["edge_id"].dataType).alias("edge_id"))
            found = found.unionByName(one)
    return found


def report(records: DataFrame, node_fields: dict, edge_rules: list, found: DataFrame) -> DataFrame:
    """One row: records, edge rules and node fields of a mapping, errors found, and whether the graph is valid.  A graph
    that is not valid is reported, not refused."""
    return records.agg(F.count("*").alias("records")).join(F.broadcast(found.agg(F.count("*").alias("errors")))).select(
        "records", F.lit(len(edge_rules)).alias("edge_rules"), F.lit(len(node_fields)).alias("node_fields"), "errors", (F.col("errors") == 0).alias("valid")
    )
