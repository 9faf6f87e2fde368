"""Queries of calibration, convergence and mutual neighbours, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, similarity
from ..sources import calendar, graphs
from ..sources.graphs import table
from .catalogue import _ORDER, _day, query
from .supervision import _WAVE, _suppliers, _wave, rounded

_MEASURES = {
    "objective": "o_totalprice / 100000", "critical": "o_orderkey % 7", "coupling": "o_custkey % 5", "edits": "o_orderkey % 3", "confusion": "o_orderkey % 11",
    "forgetting": "o_custkey % 3", "churn": "o_orderkey % 2", "retention": "o_custkey % 7", "diversity": "o_orderkey % 5", "converged": "CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END",
}
_MEANS = "means AS (SELECT o_custkey % 20 AS config, " + ", ".join(f"avg(CAST({x} AS DOUBLE)) AS {c}" for c, x in _MEASURES.items()) + " FROM orders GROUP BY 1)"
_SCORED = f"{_MEANS}, scored AS (SELECT *, " + " + ".join(f"CAST({w} AS DOUBLE) * {c}" for c, w in calibration.WEIGHTS.items()) + " AS score FROM means)"


def _scored(spark, sf_dir):
    """Twenty settings; every order is a run of one of them."""
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("config"), *[F.expr(x).alias(c) for c, x in _MEASURES.items()])
    return calibration.scores(runs, "config")


@query(f"WITH {_SCORED} SELECT config, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*_MEASURES, "score"]) + " FROM scored")
def calibration_scores(spark, sf_dir):
    return rounded(_scored(spark, sf_dir), *_MEASURES, "score")


@query(f"""WITH {_SCORED}, best AS (SELECT config FROM scored ORDER BY score, config LIMIT (SELECT greatest(1, CAST(round_even(count(*) * CAST(0.3 AS DOUBLE), 0) AS BIGINT)) FROM scored))
SELECT count(*) AS settings, min(config / CAST(20 AS DOUBLE)) AS low_gain, max(config / CAST(20 AS DOUBLE)) AS high_gain, min(config * 7 % 20 / CAST(20 AS DOUBLE)) AS low_damping, max(config * 7 % 20 / CAST(20 AS DOUBLE)) AS high_damping FROM best""")
def calibration_window(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    config = F.col("config")
    candidates = scored.select("config", (config / F.lit(20.0)).alias("gain"), (config * 7 % 20 / F.lit(20.0)).alias("damping"))
    return calibration.best_window(scored, candidates, "config", ["gain", "damping"])


@query("""WITH c AS (SELECT user_id, row_number() OVER w AS i, CAST(coalesce(abs(value / 1000 - lag(value / 1000) OVER w) < CAST(0.015 AS DOUBLE) AND value / 200 <= greatest(CAST(0.12 AS DOUBLE), CAST(0.8 AS DOUBLE) * (value / 100))
  AND abs(value / 5000) < CAST(0.02 AS DOUBLE) AND event_type <> 'purchase', false) AS INT) AS calm FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, calm + lag(calm) OVER (PARTITION BY user_id ORDER BY i) AS n FROM c) SELECT user_id, CAST(min(i) FILTER (WHERE n = 2) AS INT) AS ended FROM s GROUP BY 1""")
def convergence(spark, sf_dir):
    """A user's events as steps of a run; the scales always agree."""
    value = F.col("value")
    steps = graphs.user_activity(spark, sf_dir).select("user_id", *_ORDER, (value / 1000).alias("distance"), (value / 100).alias("before"), (value / 200).alias("after"), (value / 5000).alias("shift"), F.lit(0.6).alias("consistency"), (F.col("event_type") != "purchase").alias("flat"), F.lit(True).alias("still"))
    return calibration.converged(steps, "user_id", _ORDER, block=_day())


@query(f"SELECT s_suppkey AS node, round(greatest(-5, least(5, {_WAVE.replace('node', 's_suppkey')} + CASE WHEN s_suppkey % 5 < 4 THEN (s_suppkey % 5 - 1) * 3.0 ELSE 0 END)), 6) AS impact FROM supplier")
def cluster_projection(spark, sf_dir):
    """Clusters by the key; the last of five has no control."""
    nodes = _suppliers(spark, sf_dir)
    cluster = nodes.withColumn("cluster", F.col("node") % 5)
    controls = cluster.where("cluster < 4").select("cluster").distinct().withColumn("control", (F.col("cluster") - 1) * 3.0)
    return rounded(calibration.projected(_wave(nodes), cluster, controls), "impact")


@query("SELECT user_id, round(avg(greatest(0, value / 100 - event_id % 10 / CAST(10 AS DOUBLE))), 6) AS gain FROM events GROUP BY 1")
def refinement_gain(spark, sf_dir):
    rows = graphs.user_activity(spark, sf_dir).select("user_id", (F.col("value") / 100).alias("clusters"), (F.col("event_id") % 10 / F.lit(10.0)).alias("nodes"))
    return rounded(calibration.refinement(rows, "user_id"), "gain")


@query("""WITH n AS (SELECT n_name AS node, CAST(n_nationkey % 7 - 3 AS DOUBLE) AS x, ln(1 + n_nationkey) AS y, CAST(n_regionkey AS DOUBLE) AS z FROM nation), m AS (SELECT *, sqrt(x * x + y * y + z * z) + 1e-12 AS norm FROM n),
p AS (SELECT a.node AS u, b.node AS v, round((a.x / a.norm) * (b.x / b.norm) + (a.y / a.norm) * (b.y / b.norm) + (a.z / a.norm) * (b.z / b.norm), 9) AS s FROM m a JOIN m b ON a.node <> b.node),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY s DESC, v) AS rank, (s + 1) / 2 AS t FROM p), k AS (SELECT *, max(t) FILTER (WHERE rank = 2) OVER (PARTITION BY u) AS second FROM r WHERE rank <= 4),
w AS (SELECT u, v, CAST(0.35 AS DOUBLE) * greatest(CAST(0.05 AS DOUBLE), t - CAST(0.65 AS DOUBLE) * second) AS w FROM k)
SELECT least(w.u, w.v) AS u, greatest(w.u, w.v) AS v, round(sum(w.w), 6) AS weight FROM w JOIN w o ON w.u = o.v AND w.v = o.u GROUP BY 1, 2""")
def mutual_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), F.array((F.col("n_nationkey") % 7 - 3).cast("double"), F.log1p("n_nationkey"), F.col("n_regionkey").cast("double")).alias("vector"))
    return rounded(calibration.mutual_neighbours(similarity.cosine_topk(rows, rows, "node", "vector", 4)), "weight")


_MEETING = """m AS (SELECT o_orderkey AS event, 'c' || o_custkey AS o, list(DISTINCT 's' || l_suppkey) AS a, o_orderpriority AS p, greatest(CAST(0.1 AS DOUBLE), CAST(sum(l_quantity) AS DOUBLE) / 100) AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority), x AS (SELECT event, h, unnest(a) AS d FROM m), who AS (SELECT event, h, d FROM x UNION ALL SELECT event, h, o FROM m)"""


def _meetings(spark, sf_dir):
    """Orders as meetings of a customer with its suppliers, at their priority; the quantity tells the hours."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.groupBy(F.col("o_orderkey").alias("event"), "o_custkey", F.col("o_orderpriority").alias("location")).agg(F.collect_set(F.concat(F.lit("s"), "l_suppkey")).alias("attendees"), (F.sum("l_quantity").cast("double") / 100).alias("hours"))
    return rows.withColumns({"organiser": F.concat(F.lit("c"), "o_custkey"), "start": F.lit(None).cast("timestamp")})


_LINES = 100_000


@query(f"""WITH {_MEETING}, e AS (SELECT o AS src, d AS dst, 'social' AS layer, round(CAST(0.8 AS DOUBLE) * m.h, 6) AS weight FROM m JOIN x USING (event)
UNION ALL SELECT a.d, b.d, 'temporal', round(CAST(0.45 AS DOUBLE) * a.h, 6) FROM who a JOIN who b ON a.event = b.event AND a.d < b.d UNION ALL SELECT o, p, 'spatial', round(CAST(0.5 AS DOUBLE) * h, 6) FROM m)
SELECT src, dst, layer, count(*) AS meetings, round(sum(weight), 4) AS weight FROM e GROUP BY 1, 2, 3""")
def calendar_edges(spark, sf_dir):
    """What two have of each other over all meetings, by layer.  Few pairs meet again within a task, so they are dealt out
    before they are counted, to tasks that each get what about so many lines make."""
    tasks = max(8, -(-table(spark, sf_dir, "lineitem").count() // _LINES))
    rows = calendar.edges(_meetings(spark, sf_dir)).select("src", "dst", "layer", "weight").repartition(tasks, "src", "dst", "layer").groupBy("src", "dst", "layer").agg(F.count("*").alias("meetings"), F.sum("weight").alias("weight"))
    return rows.withColumn("weight", F.round("weight", 4))


@query(f"WITH {_MEETING} SELECT d AS id, 'person' AS kind FROM who GROUP BY 1 UNION ALL SELECT DISTINCT p, 'place' FROM m")
def calendar_nodes(spark, sf_dir):
    return calendar.nodes(_meetings(spark, sf_dir))
