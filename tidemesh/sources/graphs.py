"""Layered graphs over ordinary tables.  Edges: ord (a struct that orders them), src, dst, layer, weight, ts, polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation -> supplier nation, one edge a line item; returned items have negative polarity.

    Orders meet their customers before they meet the lines, so that no line is dealt out by customer, and lines carry the
    keys of nations until all are joined."""
    t = lambda name: table(spark, sf_dir, name)
    named = lambda key, name: F.broadcast(t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)))
    bought = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "o_orderdate", "c_nationkey")
    lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(named("c_nationkey", "src"), "c_nationkey").join(named("s_nationkey", "dst"), "s_nationkey")
    ord_ = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return rows.select(
        ord_.alias("ord"), "l_orderkey", "l_linenumber", "src", "dst", F.col("o_orderpriority").alias("layer"), (F.col("l_quantity") / 10).alias("weight"),
        F.col("o_orderdate").alias("ts"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("polarity"),
    )


TRADE = """
trade AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, bn.n_name AS src, sn.n_name AS dst,
    o_orderpriority AS layer, l_quantity / 10 AS weight, o_orderdate AS ts, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS polarity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation bn ON c_nationkey = bn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey)
"""


#: Where all line items are paired, a task has about so many.
LINES = 100_000


def co_supply(spark: SparkSession, sf_dir: str, quantity: float | None = 45) -> DataFrame:
    """(u, v, weight): suppliers that fill large lines of one order, u < v, with the number of such orders; without a
    quantity all lines count."""
    if quantity is None:
        return co_supply_orders(spark, sf_dir).groupBy("u", "v").agg(F.count("*").alias("weight"))
    large = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= quantity).select("l_orderkey", "l_suppkey").distinct()
    return _paired(large).groupBy("u", "v").agg(F.count("*").alias("weight"))


def co_supply_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v): u < v for every order that both fill, whatever the quantity.  Lines are dealt out by order before they meet,
    to tasks of a fixed size: many fit the bytes by which tasks are sized otherwise, and their pairs are many more."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return _paired(lines.repartition(max(1, -(-lines.count() // LINES)), "l_orderkey").distinct())


def _paired(lines: DataFrame) -> DataFrame:
    a, b = (lines.select("l_orderkey", F.col("l_suppkey").alias(x)) for x in "uv")
    return a.join(b, "l_orderkey").where("u < v").select("u", "v")


def co_supply_links(spark: SparkSession, sf_dir: str, quantity: float | None = 45) -> DataFrame:
    """(node, nbr), both ways: of each order the smallest supplier with every other.  The components are those of
    `co_supply`, from no more links than line items."""
    lines = table(spark, sf_dir, "lineitem")
    large = (lines if quantity is None else lines.where(F.col("l_quantity") >= quantity)).select("l_orderkey", F.col("l_suppkey").alias("v"))
    first = large.groupBy("l_orderkey").agg(F.min("v").alias("u"))
    links = large.join(first, "l_orderkey").where("u < v").select("u", "v").distinct()
    return links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("node"), F.col("u").alias("nbr")))).alias("e")).select("e.*")


CO_SUPPLY = """
large AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity >= 45),
pairs AS (
  SELECT a.l_suppkey AS u, b.l_suppkey AS v, count(*) AS weight FROM large a JOIN large b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
  GROUP BY ALL),
adj AS (SELECT u AS node, v AS nbr, weight FROM pairs UNION ALL SELECT v, u, weight FROM pairs)
"""


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "weight").unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("nbr"), "weight"))


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def mapped(records: DataFrame, node_fields: dict[str, str], edge_rules: list[tuple[str, str, str, float]], ts: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records to (nodes, edges) by a mapping: fields that hold node ids, and rules (source field, target field, layer,
    weight).  The kind a node is first seen with holds; endpoints that no field declares are of kind `entity`."""
    good = records.where(F.col(ts).isNotNull())
    at = F.struct(*order)
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), F.lit(layer).alias("layer"), F.lit(max(0.0, float(w))).alias("weight")) for k, (a, b, layer, w) in enumerate(edge_rules)])
    edges = good.select(at.alias("at"), F.col(ts).alias("ts"), F.explode(rules).alias("e")).where("e.src is not null and e.dst is not null")
    edges = edges.select("at", "e.rule", "ts", "e.src", "e.dst", "e.layer", "e.weight")
    fields = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).cast("string").alias("id"), F.lit(kind).alias("kind")) for k, (f, kind) in enumerate(node_fields.items())])
    declared = good.select(at.alias("at"), F.explode(fields).alias("n")).where("n.id is not null").select(F.struct("at", "n.k").alias("first"), F.col("n.id").alias("id"), F.col("n.kind").alias("kind"))
    late = F.lit(len(node_fields))
    ends = edges.select(F.struct("at", (late + F.col("rule") * 2).alias("k")).alias("first"), F.col("src").alias("id"), F.lit("entity").alias("kind")).unionByName(
        edges.select(F.struct("at", (late + F.col("rule") * 2 + 1).alias("k")).alias("first"), F.col("dst").alias("id"), F.lit("entity").alias("kind")))
    nodes = declared.unionByName(ends).groupBy("id").agg(F.min_by("kind", "first").alias("kind"))
    return nodes, edges


def default_perturbation(records: DataFrame, target: str, ts: str, order: list[str], intensity: float = 1.0) -> DataFrame:
    """One row: the most frequent target, ties to the first seen, with the latest time."""
    seen = records.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("target")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    best = seen.orderBy(F.desc("n"), "first").limit(1)
    return best.crossJoin(records.agg(F.max(ts).alias("ts"))).select("target", "n", "ts", F.lit(max(0.0, intensity)).alias("intensity"))


def sign(c: Column) -> Column:
    return F.when(c > 0, 1).when(c < 0, -1).otherwise(0)
