"""Every query of the library by name, over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import planning, propagation, retrieval, series, similarity, topology, validation
from ..sources import graphs
from ..sources.graphs import CO_SUPPLY, TRADE, table
from ..streaming import activity

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _has(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


ASKED = "high flow from germany to urgent france"
_TERMS = list(dict.fromkeys(ASKED.split()))
_SCORE = " + ".join(f"CAST(contains(words, '{t}') AS INT)" for t in _TERMS)


@query(f"""WITH {TRADE}, scored AS (
  SELECT *, {_SCORE} AS score FROM (SELECT *, lower(src || ' ' || dst || ' ' || layer || ' {{}}') AS words FROM trade))
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, src, dst, layer, score FROM scored WHERE score > 0
ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate LIMIT 8""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for a question about the structure: lexical retrieval, else by degree."""
    found = retrieval.described(graphs.trade(spark, sf_dir), ASKED)
    return found.select("l_orderkey", "l_linenumber", "src", "dst", "layer", "score")


@query(f"""WITH {CO_SUPPLY}, deg AS (SELECT node, count(DISTINCT nbr) AS d FROM adj GROUP BY 1)
SELECT u, v, weight, CAST(a.d + b.d + trunc(weight) AS BIGINT) AS key FROM pairs JOIN deg a ON u = a.node JOIN deg b ON v = b.node ORDER BY 4 DESC, 1, 2 LIMIT 8""")
def describe_global(spark, sf_dir):
    pairs = graphs.co_supply(spark, sf_dir)
    return retrieval.by_degree(pairs, graphs.both_ways(pairs))


@query(f"""SELECT conv_id, turn, CASE WHEN {_has("lower(coalesce(text, ''))", retrieval.PREDICT)} THEN 'predict'
  WHEN {_has("lower(coalesce(text, ''))", retrieval.INTERVENE)} THEN 'intervene' ELSE 'describe' END AS query_type FROM conversations""")
def route_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.route(F.col("text")).alias("query_type"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(coalesce(text, '')), '{w}') THEN '{w}'" for w in retrieval.BLOCKED) + " END AS reason FROM documents")
def guardrail_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.blocked_by(F.col("text")).alias("reason"))


def _mapped(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumns({"who": F.concat(F.lit("c"), "o_custkey"), "what": F.concat(F.lit("p:"), "o_orderpriority"), "state": F.concat(F.lit("s:"), "o_orderstatus")})
    return orders, *graphs.mapped(orders, {"who": "customer", "what": "priority"}, [("who", "what", "orders", 1.0), ("who", "state", "status", 0.5)], "o_orderdate", ["o_orderkey"])


@query("""SELECT id, kind FROM (SELECT DISTINCT 'c' || o_custkey AS id, 'customer' AS kind FROM orders UNION SELECT DISTINCT 'p:' || o_orderpriority, 'priority' FROM orders
UNION SELECT DISTINCT 's:' || o_orderstatus, 'entity' FROM orders)""")
def graph_nodes(spark, sf_dir):
    return _mapped(spark, sf_dir)[1]


@query("""SELECT o_orderkey, 0 AS rule, 'c' || o_custkey AS src, 'p:' || o_orderpriority AS dst, 'orders' AS layer, CAST(1 AS DOUBLE) AS weight FROM orders UNION ALL
SELECT o_orderkey, 1, 'c' || o_custkey, 's:' || o_orderstatus, 'status', CAST(0.5 AS DOUBLE) FROM orders""")
def graph_edges(spark, sf_dir):
    return _mapped(spark, sf_dir)[2].select("at.o_orderkey", "rule", "src", "dst", "layer", "weight")


@query("""SELECT 'c' || o_custkey AS target, count(*) AS n, CAST(1 AS DOUBLE) AS intensity FROM orders GROUP BY o_custkey ORDER BY 2 DESC, min(o_orderkey) LIMIT 1""")
def default_perturbation(spark, sf_dir):
    return graphs.default_perturbation(_mapped(spark, sf_dir)[0], "who", "o_orderdate", ["o_orderkey"]).select("target", "n", "intensity")


@query(f"""WITH {TRADE}, marked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) > 1 AS again,
    max(ts) OVER (PARTITION BY src, dst, layer ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts AS late FROM trade), found AS (
  SELECT 'duplicate_interaction_id' AS code FROM marked WHERE again UNION ALL SELECT 'self_loop_not_allowed' FROM marked WHERE src = dst
  UNION ALL SELECT 'weight_out_of_range' FROM marked WHERE weight < 0 OR weight > 5 UNION ALL SELECT 'timestamp_backwards' FROM marked WHERE late)
SELECT code, count(*) AS n FROM found GROUP BY 1""")
def validate_graph(spark, sf_dir):
    edges = graphs.trade(spark, sf_dir).withColumn("edge_id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"))
    return validation.issues(edges, nodes, block=F.expr("l_orderkey div 1048576")).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {CO_SUPPLY} SELECT node, count(DISTINCT nbr) AS simple, CAST(sum(weight) AS BIGINT) AS weighted, count(*) AS rows FROM adj GROUP BY 1")
def degrees(spark, sf_dir):
    return retrieval.degrees(graphs.both_ways(graphs.co_supply(spark, sf_dir)))


_STATE = """state AS (
  SELECT entity, sum(n) AS edges, sum(t) AS temporal, count(*) AS nbrs FROM (
    SELECT user_id AS entity, event_type AS nbr, count(*) AS n, count(*) FILTER (WHERE layer = 'temporal') AS t FROM layered GROUP BY 1, 2) GROUP BY 1),
lay AS (SELECT user_id AS entity, count(DISTINCT layer) AS layers, count(*) FILTER (WHERE layer = 'spatial') AS spatial FROM layered GROUP BY 1),
total AS (SELECT count(DISTINCT user_id) + count(DISTINCT event_type) AS nodes FROM layered),
ent AS (SELECT entity, sum(-p * ln(p + 1e-9)) AS h FROM (
  SELECT user_id AS entity, event_type, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM layered GROUP BY 1, 2) GROUP BY 1)"""
_LAYERED = "layered AS (SELECT *, CASE event_type WHEN 'click' THEN 'temporal' WHEN 'view' THEN 'spatial' ELSE 'social' END AS layer FROM events)"


def _users(spark, sf_dir):
    layer = F.when(F.col("event_type") == "click", "temporal").when(F.col("event_type") == "view", "spatial").otherwise("social")
    events = graphs.user_activity(spark, sf_dir)
    total = events.agg(F.countDistinct("user_id") + F.countDistinct("event_type"))
    return propagation.state_vectors(events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("nbr"), layer.alias("layer")), total)


@query(f"""WITH {_LAYERED}, {_STATE} SELECT entity, round(h, 6) AS social_entropy, round(least(1.0, CAST(temporal AS DOUBLE) / edges), 6) AS temporal_regularity, spatial AS spatial_range, round(CAST(nbrs AS DOUBLE) / greatest(1, nodes - 1), 6) AS network_centrality, layers AS n_layers,
  CAST(edges AS BIGINT) AS schedule_density, nbrs AS neighbours, round(CAST(layers AS DOUBLE) / edges, 6) AS transition_speed FROM state JOIN lay USING (entity) JOIN ent USING (entity), total""")
def state_vectors(spark, sf_dir):
    rows = _users(spark, sf_dir)
    return rows.withColumns({c: F.round(c, 6) for c in ("social_entropy", "temporal_regularity", "network_centrality", "transition_speed")})


@query(f"""WITH {_LAYERED}, {_STATE} SELECT entity, CASE WHEN CAST(temporal AS DOUBLE) / edges >= 0.7 AND CAST(layers AS DOUBLE) / edges <= 0.5 THEN 'stable_routine'
  WHEN CAST(layers AS DOUBLE) / edges >= 0.7 OR edges >= 6 THEN 'high_flux' ELSE 'adaptive' END AS label FROM state JOIN lay USING (entity)""")
def state_class(spark, sf_dir):
    return _users(spark, sf_dir).select("entity", series.state_class(F.col("temporal_regularity"), F.col("transition_speed"), F.col("schedule_density")).alias("label"))


@query(f"""WITH {CO_SUPPLY}, n AS (SELECT count(DISTINCT node) AS n FROM adj), m AS (SELECT count(*) AS m FROM pairs)
SELECT n AS nodes, m AS edges, round(least(1.0, m / greatest(1, n * (n - 1) / 2.0)), 6) AS density FROM n, m""")
def graph_profile(spark, sf_dir):
    pairs = graphs.co_supply(spark, sf_dir)
    both = pairs.select(F.explode(F.array("u", "v")).alias("n")).agg(F.countDistinct("n").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges"))
    density = F.least(F.lit(1.0), F.col("edges") / F.greatest(F.lit(1.0), F.col("nodes") * (F.col("nodes") - 1) / 2))
    return both.withColumn("density", F.round(density, 6))


def _shock(spark, sf_dir):
    """The co-supply graph with the polarity of its pairs (even sums of keys push, odd ones pull) and the busiest node."""
    adj = graphs.both_ways(graphs.co_supply(spark, sf_dir))
    deg = retrieval.degrees(adj)
    return adj, deg.orderBy(F.desc("simple"), "node").limit(1).select("node", F.lit(1.0).alias("impact"))


def _spread_sql(polarity: str) -> str:
    steps, s = "", 1.0
    for k in (1, 2, 3):
        s /= 2
        steps += f""", g{k} AS (SELECT nbr AS node, sum(CASE WHEN s.impact >= 0 THEN 1 ELSE -1 END * {polarity} * {s}) AS given FROM s{k - 1} s JOIN adj ON s.node = adj.node WHERE hop = {k - 1} GROUP BY 1),
s{k} AS (SELECT coalesce(s.node, g.node) AS node, coalesce(impact, 0) + coalesce(given, 0) AS impact, coalesce(hop, {k}) AS hop FROM s{k - 1} s FULL JOIN g{k} g ON s.node = g.node)"""
    return f"""WITH {CO_SUPPLY}, s0 AS (SELECT node, CAST(1 AS DOUBLE) AS impact, 0 AS hop FROM (SELECT node FROM adj GROUP BY node ORDER BY count(DISTINCT nbr) DESC, node LIMIT 1)){steps}"""


@query(_spread_sql("1") + " SELECT node, round(impact, 6) AS impact, CAST(hop AS INT) AS hop FROM s3")
def propagate_impact(spark, sf_dir):
    adj, seed = _shock(spark, sf_dir)
    return propagation.spread(seed, adj.withColumn("polarity", F.lit(1))).withColumn("impact", F.round("impact", 6))


@query(_spread_sql("(1 - 2 * ((adj.node + adj.nbr) % 2))") + " SELECT node, round(impact, 6) AS impact, CAST(hop AS INT) AS hop FROM s3")
def propagate_signed(spark, sf_dir):
    adj, seed = _shock(spark, sf_dir)
    return propagation.spread(seed, adj.withColumn("polarity", 1 - 2 * ((F.col("node") + F.col("nbr")) % 2))).withColumn("impact", F.round("impact", 6))


@query(_spread_sql("1") + """, r AS (SELECT row_number() OVER (ORDER BY abs(impact) DESC, node) AS rank, node, lead(node) OVER (ORDER BY abs(impact) DESC, node) AS nbr FROM s3 WHERE abs(impact) >= 0.25)
SELECT CAST(rank AS INT) AS rank, node, nbr FROM r WHERE nbr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM adj WHERE adj.node = r.node AND adj.nbr = r.nbr) ORDER BY rank LIMIT 3""")
def rewire_suggestions(spark, sf_dir):
    adj, seed = _shock(spark, sf_dir)
    return propagation.rewires(propagation.spread(seed, adj.withColumn("polarity", F.lit(1))), adj)


@query(f"""WITH {CO_SUPPLY}, f0 AS (SELECT node, CAST(1 AS DOUBLE) AS s FROM (SELECT node FROM adj GROUP BY node ORDER BY count(DISTINCT nbr) DESC, node LIMIT 1)),
t1 AS (SELECT nbr AS node, s * 0.6 AS s FROM f0 JOIN adj USING (node)), f1 AS (SELECT node, max(s) AS s FROM t1 GROUP BY 1),
t2 AS (SELECT nbr AS node, s * 0.6 AS s FROM f1 JOIN adj USING (node)), f2 AS (SELECT node, max(s) AS s FROM t2 GROUP BY 1),
t3 AS (SELECT nbr AS node, s * 0.6 AS s FROM f2 JOIN adj USING (node))
SELECT node, round(sum(s), 6) AS score FROM (FROM f0 UNION ALL FROM t1 UNION ALL FROM t2 UNION ALL FROM t3) GROUP BY 1 ORDER BY round(sum(s), 9) DESC, 1 LIMIT 3""")
def truth_topk(spark, sf_dir):
    adj, seed = _shock(spark, sf_dir)
    return propagation.strongest(seed, adj).withColumn("score", F.round("score", 6))


@query(f"""WITH {TRADE}, s AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, CAST(sum(l_quantity) FILTER (WHERE ts < TIMESTAMP '1996-01-01') AS BIGINT) AS o,
  CAST(sum(l_quantity) FILTER (WHERE ts >= TIMESTAMP '1996-01-01') AS BIGINT) AS n FROM trade GROUP BY 1, 2)
SELECT u, v, coalesce(o, 0) AS old, coalesce(n, 0) AS new, coalesce(n, 0) - coalesce(o, 0) AS delta, CASE WHEN coalesce(o, 0) = 0 THEN 'added' WHEN coalesce(n, 0) = 0 THEN 'removed' ELSE 'weight' END AS kind
FROM s WHERE coalesce(n, 0) <> coalesce(o, 0) ORDER BY abs(coalesce(n, 0) - coalesce(o, 0)) DESC, 1, 2 LIMIT 8""")
def edge_delta(spark, sf_dir):
    edges = graphs.trade(spark, sf_dir).withColumn("tenths", F.round(F.col("weight") * 10).cast("long"))
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    return retrieval.edge_delta(edges.where(F.col("ts") < cut), edges.where(F.col("ts") >= cut), weight="tenths")


def _labels(spark, sf_dir):
    return graphs.user_activity(spark, sf_dir).select("user_id", "ts", "event_id", F.col("event_type").alias("label"), "value")


_ORDER = ["ts", "event_id"]


def _day():
    """Where long runs of events are cut."""
    return F.date_trunc("day", F.col("ts"))


@query("""WITH s AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), c AS (SELECT src, dst, count(*) AS n FROM s WHERE dst IS NOT NULL GROUP BY ALL)
SELECT src, dst, n, CAST(sum(n) OVER (PARTITION BY src) AS BIGINT) AS total, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src), 6) AS p FROM c""")
def transition_matrix(spark, sf_dir):
    return series.transitions(_labels(spark, sf_dir), "user_id", _ORDER, block=_day()).withColumn("p", F.round(F.col("n") / F.col("total"), 6))


@query("""SELECT user_id, label, n FROM (SELECT user_id, event_type AS label, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ts), min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def dominant_state(spark, sf_dir):
    return series.dominant(_labels(spark, sf_dir), "user_id", _ORDER)


@query("""WITH a AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM events),
b AS (SELECT user_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM a), d AS (SELECT user_id, i, count(*) AS n FROM b GROUP BY 1, 2)
SELECT user_id, max(n) AS longest, CAST(sum(n) AS BIGINT) AS length, count(*) - 1 AS switches FROM d GROUP BY 1""")
def persistence(spark, sf_dir):
    return series.persistence(_labels(spark, sf_dir), "user_id", _ORDER, block=_day())


_STEP = "SELECT user_id, ts, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events"


@query(f"""WITH s AS ({_STEP}), m AS (SELECT *, sign(d) AS g FROM s WHERE abs(d) > 1e-9), t AS (SELECT *, CAST(g <> lag(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS f FROM m),
c AS (SELECT user_id, coalesce(sum(f), 0) AS flips, count(*) - 1 AS chances FROM t GROUP BY 1)
SELECT user_id, n, CAST(coalesce(flips, 0) AS BIGINT) AS flips, coalesce(chances, 0) AS chances FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) LEFT JOIN c USING (user_id)""")
def sign_flip(spark, sf_dir):
    return series.flips(_labels(spark, sf_dir), "user_id", _ORDER, "value", block=_day())


@query("""WITH r AS (SELECT user_id, value AS x, row_number() OVER w AS i, first_value(value) OVER w AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
  abs(value - lag(value) OVER w) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n, any_value(f) AS first_value, any_value(l) AS last_value, CAST(coalesce(min(CASE WHEN x <= f / 2 THEN i END), count(*)) AS BIGINT) AS recovery_steps,
  round(greatest(0, max(x) - any_value(f)), 6) AS overshoot, CAST(coalesce(max(CASE WHEN abs(x - l) > greatest(1e-6, abs(l) * 0.05) THEN i END), 0) + 1 AS BIGINT) AS settling, round(coalesce(sum(step), 0), 6) AS path FROM r GROUP BY 1""")
def resilience(spark, sf_dir):
    rows = series.resilience(_labels(spark, sf_dir), "user_id", _ORDER, "value", block=_day())
    return rows.withColumns({"overshoot": F.round("overshoot", 6), "path": F.round("path", 6), "recovery_steps": F.col("recovery_steps").cast("long"), "settling": F.col("settling").cast("long")})


@query("""WITH d AS (SELECT event_type AS run, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS speed, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS dist, CAST(count(DISTINCT user_id) AS DOUBLE) AS tension FROM events GROUP BY 1, 2),
n AS (SELECT run, day, 0.45 * (speed - min(speed) OVER w) / (max(speed) OVER w - min(speed) OVER w) + 0.35 * (dist - min(dist) OVER w) / (max(dist) OVER w - min(dist) OVER w)
  + 0.2 * (tension - min(tension) OVER w) / (max(tension) OVER w - min(tension) OVER w) AS o FROM d WINDOW w AS (PARTITION BY run))
SELECT run, day, round(o, 6) AS order_parameter, CASE WHEN o < 0.33 THEN 'calm' WHEN o < 0.66 THEN 'adaptive' ELSE 'turbulent' END AS regime,
  round(o - lag(o) OVER (PARTITION BY run ORDER BY day), 6) AS change, round(var_pop(o) OVER (PARTITION BY run ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling FROM n""")
def phase_scores(spark, sf_dir):
    events = graphs.user_activity(spark, sf_dir)
    days = events.groupBy(F.col("event_type").alias("run"), F.col("ts").cast("date").alias("day")).agg(
        F.count("*").cast("double").alias("speed"), (F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*")).alias("dist"), F.countDistinct("user_id").cast("double").alias("tension"))
    return series.phase(days, "run", ["day"]).withColumns({c: F.round(c, 6) for c in ("order_parameter", "change", "rolling")})


_TRI = f"WITH {CO_SUPPLY}, tri AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM pairs x JOIN pairs y ON x.u = y.u AND x.v < y.v JOIN pairs z ON z.u = x.v AND z.v = y.v)"


@query(_TRI + " SELECT a, b, c FROM tri")
def triangles(spark, sf_dir):
    return topology.triangles(graphs.co_supply(spark, sf_dir))


_QUAD = _TRI + ", quad AS (SELECT x.a, x.b, x.c, y.c AS d FROM tri x JOIN tri y ON x.a = y.a AND x.b = y.b AND x.c < y.c JOIN pairs z ON z.u = x.c AND z.v = y.c)"
_PART = _QUAD + """, t AS (SELECT node, count(*) AS triangles FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1),
q AS (SELECT node, count(*) AS cliques FROM (SELECT a AS node FROM quad UNION ALL SELECT b FROM quad UNION ALL SELECT c FROM quad UNION ALL SELECT d FROM quad) GROUP BY 1), nodes AS (SELECT node, count(DISTINCT nbr) AS d FROM adj GROUP BY 1)"""


@query(_PART + " SELECT node, coalesce(triangles, 0) AS triangles, coalesce(cliques, 0) AS cliques FROM nodes LEFT JOIN t USING (node) LEFT JOIN q USING (node)")
def simplex_participation(spark, sf_dir):
    pairs = graphs.co_supply(spark, sf_dir)
    three = topology.triangles(pairs)
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return topology.participation(nodes, three, topology.four_cliques(three, pairs))


@query(_PART + " SELECT node, coalesce(triangles, 0) AS triangles, CAST(d * (d - 1) / 2 AS BIGINT) AS wedges, round(CASE WHEN d < 2 THEN 0 ELSE coalesce(triangles, 0) / (d * (d - 1) / 2.0) END, 6) AS closed FROM nodes LEFT JOIN t USING (node)")
def cycle_pressure(spark, sf_dir):
    pairs = graphs.co_supply(spark, sf_dir)
    three = topology.triangles(pairs)
    count = three.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    deg = retrieval.degrees(graphs.both_ways(pairs))
    rows = topology.clustering(deg.select("node").join(count, "node", "left").fillna(0, ["triangles"]), deg)
    return rows.withColumn("closed", F.round(F.when(F.col("wedges") > 0, F.col("triangles") / F.col("wedges")).otherwise(0.0), 6))


@query(f"""WITH {TRADE}, imp AS (SELECT n_name AS node, CAST(n_nationkey AS DOUBLE) / 25 AS i FROM nation), f AS (SELECT src, dst, b.i - a.i + 0.05 * weight AS f FROM trade JOIN imp a ON src = a.node JOIN imp b ON dst = b.node WHERE src <> dst)
SELECT node, round(sum(f), 4) AS div FROM (SELECT dst AS node, f FROM f UNION ALL SELECT src, -f FROM f) GROUP BY 1""")
def edge_flow_divergence(spark, sf_dir):
    impact = table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), (F.col("n_nationkey").cast("double") / 25).alias("impact"))
    return topology.divergence(graphs.trade(spark, sf_dir), impact).withColumn("div", F.round("div", 4))


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("cluster"))


@query(f"""WITH {TRADE}, c AS (SELECT n_name AS node, r_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT least(a.c, b.c) AS c1, greatest(a.c, b.c) AS c2, count(*) AS n FROM trade JOIN c a ON src = a.node JOIN c b ON dst = b.node WHERE a.c <> b.c GROUP BY 1, 2""")
def cluster_graph(spark, sf_dir):
    return topology.contracted(graphs.trade(spark, sf_dir), _regions(spark, sf_dir))


@query("""WITH v AS (SELECT c_mktsegment AS cluster, CAST(round(c_acctbal * 100) AS BIGINT) AS x FROM customer)
SELECT cluster, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, CAST(sum(abs(x)) AS BIGINT) AS absolute, arg_max(x, (abs(x), x)) AS largest,
  round(CASE WHEN sum(abs(x)) = 0 THEN 0 ELSE sign(sum(x)) * (sum(abs(x)) / 100.0 / count(*)) * (0.3 + 0.7 * abs(sum(x)) / sum(abs(x))) END, 4) AS value FROM v GROUP BY 1""")
def cluster_impact(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cluster"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    rows = topology.cluster_impact(values)
    direction = F.when(F.col("total") == 0, F.signum("largest")).otherwise(F.signum("total"))
    value = direction * (F.col("absolute") / 100 / F.col("n")) * (0.3 + 0.7 * F.abs("total") / F.col("absolute"))
    return rows.withColumn("value", F.round(F.when(F.col("absolute") == 0, 0.0).otherwise(value), 4))


@query(f"""WITH {TRADE}, c AS (SELECT n_name AS node, r_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT src AS node, c, count(*) AS n FROM trade JOIN c ON dst = c.node GROUP BY ALL),
p AS (SELECT node, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY node) AS p FROM n) SELECT node, round(sum(-p * ln(p + 1e-12)), 6) AS entropy FROM p GROUP BY 1""")
def mixing_entropy(spark, sf_dir):
    edges = graphs.trade(spark, sf_dir).select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    return topology.mixing(edges, _regions(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


@query("""WITH a AS (SELECT user_id, max(ts) AS seen, count(*) AS hits FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, hits, round(power(2.0, -date_diff('day', CAST(seen AS DATE), CAST(now AS DATE)) / 40.0) * (1 + 0.25 * ln(1 + hits)), 6) AS retention FROM a, m""")
def importance_retention(spark, sf_dir):
    """Retention of a context of importance 1: halved every 40 days, raised by its hits."""
    events = graphs.user_activity(spark, sf_dir)
    now = events.agg(F.max("ts").alias("now"))  # one row
    per = events.groupBy("user_id").agg(F.max("ts").alias("seen"), F.count("*").alias("hits")).join(F.broadcast(now))
    age = F.datediff("now", "seen")
    return per.select("user_id", "hits", F.round(F.pow(F.lit(2.0), -age / 40) * (1 + 0.25 * F.log(1 + F.col("hits"))), 6).alias("retention"))


_DAILY = """daily AS (SELECT *, CASE WHEN regularity >= 0.7 AND speed <= 0.5 THEN 'stable_routine' WHEN speed >= 0.7 OR density >= 6 THEN 'high_flux' ELSE 'adaptive' END AS label FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) / count(*) AS regularity, CAST(count(DISTINCT event_type) AS DOUBLE) / count(*) AS speed,
    CAST(count(*) AS DOUBLE) AS density FROM events GROUP BY 1, 2))"""


def _daily(spark, sf_dir):
    """A state of each user and day: share of clicks, types an event, events."""
    n = F.count("*").cast("double")
    rows = graphs.user_activity(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        (F.count_if(F.col("event_type") == "click").cast("double") / n).alias("regularity"), (F.countDistinct("event_type").cast("double") / n).alias("speed"), n.alias("density"))
    return rows.withColumn("label", series.state_class(F.col("regularity"), F.col("speed"), F.col("density")))


@query(f"""WITH s AS ({_STEP}), m AS (SELECT *, sign(d) AS g FROM s WHERE d <> 0), t AS (SELECT *, CAST(g <> lag(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS f FROM m),
c AS (SELECT user_id, coalesce(sum(f), 0) AS flips FROM t GROUP BY 1)
SELECT user_id, n, round(CASE WHEN n < 3 THEN 0 ELSE CAST(coalesce(flips, 0) AS DOUBLE) / (n - 2) END, 6) AS oscillation FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) LEFT JOIN c USING (user_id)""")
def oscillation(spark, sf_dir):
    rows = series.flips(_labels(spark, sf_dir), "user_id", _ORDER, "value", 0.0, block=_day())
    return rows.select("user_id", "n", F.round(F.when(F.col("n") < 3, 0.0).otherwise(F.col("flips") / (F.col("n") - 2)), 6).alias("oscillation"))


@query("""WITH x AS (SELECT user_id, ts, event_id, value AS x, lag(value) OVER w AS y, row_number() OVER w AS i, var_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT user_id, count(*) AS n, sqrt(var_pop(CASE WHEN y IS NOT NULL THEN x END) * var_pop(y)) * (count(*) - 1) AS den, CASE WHEN count(*) > 2 THEN covar_pop(x, y) / nullif(sqrt(var_pop(CASE WHEN y IS NOT NULL THEN x END) * var_pop(y)), 0) END AS r,
  arg_min(v, i) FILTER (WHERE i >= 3) AS f, arg_max(v, i) FILTER (WHERE i >= 3) AS l FROM x GROUP BY 1),
b AS (SELECT *, CASE WHEN n < 3 OR den <= 1e-9 THEN 0 ELSE (r + 1) / 2 END AS c, CASE WHEN n = 3 THEN l ELSE greatest(0, l - f) END AS t FROM a)
SELECT user_id, n, round(c, 6) AS autocorrelation, round(CASE WHEN n < 3 THEN 0 ELSE least(1, 0.65 * c + 0.35 * least(1, 4 * t)) END, 6) AS slowing FROM b""")
def critical_slowing(spark, sf_dir):
    return series.slowing(_labels(spark, sf_dir), "user_id", _ORDER, "value", block=_day()).withColumns({c: F.round(c, 6) for c in ("autocorrelation", "slowing")})


@query(f"""WITH {_DAILY}, d AS (SELECT user_id, day, label, lag(label) OVER w AS was, speed - lag(speed) OVER w AS s, lag(regularity) OVER w - regularity AS r, density - lag(density) OVER w AS d FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, was, label, CASE WHEN s > 0.15 OR r > 0.15 OR d > 0.5 THEN concat_ws(',', CASE WHEN s > 0.15 THEN 'speed_jump' END, CASE WHEN r > 0.15 THEN 'regularity_drop' END, CASE WHEN d > 0.5 THEN 'density_jump' END)
  ELSE 'state_boundary_crossed' END AS reasons, round(least(1, 1.8 * greatest(0, s) + 1.6 * greatest(0, r) + 0.6 * greatest(0, d)), 6) AS confidence FROM d WHERE label <> was""")
def triggers(spark, sf_dir):
    return series.triggers(_daily(spark, sf_dir), "user_id", ["day"]).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {_DAILY}, m AS (SELECT user_id, label AS main FROM (SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(day)) AS r FROM daily GROUP BY 1, 2) WHERE r = 1),
c AS (SELECT user_id, avg(regularity) AS a, avg(speed) AS b, avg(density) AS e FROM daily JOIN m USING (user_id) WHERE label = main GROUP BY 1),
f AS (SELECT user_id, label = main AS inside, sqrt((regularity - a) ** 2 + (speed - b) ** 2 + (density - e) ** 2) AS d FROM daily JOIN m USING (user_id) JOIN c USING (user_id)),
r AS (SELECT user_id, avg(d) + stddev_pop(d) AS radius FROM f WHERE inside GROUP BY 1)
SELECT user_id, round(any_value(radius), 6) AS radius, round(avg(CASE WHEN d <= radius + 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS occupancy FROM f JOIN r USING (user_id) GROUP BY 1""")
def basin(spark, sf_dir):
    rows = series.basin(_daily(spark, sf_dir), "user_id", ["day"], ["regularity", "speed", "density"])
    return rows.withColumns({c: F.round(c, 6) for c in ("radius", "occupancy")})


@query(f"""WITH {_DAILY}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM daily),
e AS (SELECT user_id, {", ".join(f"max({c}) FILTER (WHERE i = n) - max({c}) FILTER (WHERE i = least(n, 2)) AS {c}" for c in ("regularity", "speed", "density"))} FROM x GROUP BY 1)
SELECT user_id, round((CASE WHEN regularity > 0 THEN 1 ELSE 0 END + CASE WHEN speed < 0 THEN 0.5 ELSE 0 END + CASE WHEN density > 0 THEN 0.25 ELSE 0 END) / CAST(1.75 AS DOUBLE), 6) AS aligned FROM e""")
def causal_alignment(spark, sf_dir):
    rows = series.alignment(_daily(spark, sf_dir), "user_id", ["day"], {"regularity": 1.0, "speed": -0.5, "density": 0.25})
    return rows.withColumn("aligned", F.round("aligned", 6))


_PRESS = _QUAD + """, i AS (SELECT node, CAST(count(DISTINCT nbr) AS DOUBLE) AS i FROM adj GROUP BY 1),
p AS (SELECT x.*, y.i AS ib, z.i AS ic, (w.i + y.i + z.i) / 3 AS m, w.i AS ia FROM tri x JOIN i w ON a = w.node JOIN i y ON b = y.node JOIN i z ON c = z.node),
q AS (SELECT a, b, c, d, w.i AS ia, y.i AS ib, z.i AS ic, g.i AS id, (w.i + y.i + z.i + g.i) / 4 AS m FROM quad JOIN i w ON a = w.node JOIN i y ON b = y.node JOIN i z ON c = z.node JOIN i g ON d = g.node),
s AS (SELECT node, sum(x) AS s FROM (""" + " UNION ALL ".join(
    f"SELECT {n} AS node, {w} * (0.5 * i{n} + 0.5 * m) AS x FROM {t}" for t, w, names in (("p", 0.6, "abc"), ("q", "1.0", "abcd")) for n in names) + ") GROUP BY 1)"


@query(_PRESS + " SELECT node, round(s / (SELECT max(s) FROM s), 6) AS pressure FROM s")
def tetra_pressure(spark, sf_dir):
    pairs = graphs.co_supply(spark, sf_dir)
    three = topology.triangles(pairs)
    impact = retrieval.degrees(graphs.both_ways(pairs)).select("node", F.col("simple").cast("double").alias("impact"))
    return topology.simplex_pressure(impact, three, topology.four_cliques(three, pairs)).withColumn("pressure", F.round("pressure", 6))


@query("WITH RECURSIVE " + CO_SUPPLY.replace(">= 45", ">= 50") + """, reach AS (SELECT DISTINCT node, node AS peer FROM adj UNION SELECT reach.node, adj.nbr FROM reach JOIN adj ON reach.peer = adj.node)
SELECT node, min(peer) AS component FROM reach GROUP BY 1""")
def components(spark, sf_dir):
    return topology.components(graphs.co_supply_links(spark, sf_dir, 50))


@query()
def components_whole(spark, sf_dir):
    """Components over all line items, large or not."""
    return topology.components(graphs.co_supply_links(spark, sf_dir, None))


@query("""WITH u AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)),
s AS (SELECT q.vec_id AS query, u.vec_id AS item, round(list_dot_product(q.v, u.v), 9) AS score FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, item, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INT) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    """The stated query set, every row whose id is divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return similarity.cosine_topk(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


_BALANCE = "v AS (SELECT c_mktsegment AS cluster, c_acctbal AS x FROM customer)"


def _balances(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cluster"), F.col("c_acctbal").alias("value"))


@query(f"""WITH {_BALANCE}, a AS (SELECT cluster, count(*) AS n, sum(x) AS t, sum(abs(x)) AS s, var_pop(x) AS q FROM v GROUP BY 1)
SELECT cluster, n, round(CASE WHEN s <= 1e-12 THEN 1 ELSE 0.55 * abs(t) / s + 0.45 / (1 + q / ((s / n) * (s / n) + 1e-9)) END, 6) AS score FROM a""")
def cross_scale(spark, sf_dir):
    return similarity.cross_scale(_balances(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BALANCE}, m AS (SELECT avg(x) AS m FROM v GROUP BY cluster ORDER BY 1 DESC LIMIT 2), t AS (SELECT max(m) AS a, CASE WHEN count(*) > 1 THEN min(m) ELSE 0 END AS b FROM m)
SELECT round(least(1, greatest(0, (a - b) / (abs(a) + abs(b) + 1e-9))), 6) AS margin FROM t""")
def cluster_margin(spark, sf_dir):
    return similarity.margin(_balances(spark, sf_dir)).withColumn("margin", F.round("margin", 6))


@query(f"""WITH {CO_SUPPLY}, e AS (SELECT u, v, weight, (u % 7 - 3) / CAST(3 AS DOUBLE) AS a, (v % 7 - 3) / CAST(3 AS DOUBLE) AS b FROM pairs),
g AS (SELECT *, abs(a) + abs(b) AS mass, abs(a - b) / greatest(1e-6, abs(a) + abs(b)) AS gap, CASE WHEN a * b >= 0 THEN 1 ELSE 0 END AS same FROM e), h AS (SELECT *, greatest(0, 1 - gap) AS stab FROM g)
SELECT u, v, weight, round(weight + 0.375 * (0.5 * mass) / (1 + 0.5 * mass) * (0.55 * stab + 0.45 * same) - 0.23 * (1 - same) * (0.5 + 0.5 * (1 - stab)) - 0.04 * gap, 9) AS score FROM h""")
def drop_scores(spark, sf_dir):
    pairs = graphs.co_supply(spark, sf_dir)
    impact = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("impact", (F.col("node") % 7 - 3) / F.lit(3.0))
    return planning.drop_scores(pairs, impact, 0.5).withColumn("score", F.round("score", 9))


@query("SELECT user_id AS entity, CAST(ts AS DATE) AS start, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def windowed_activity(spark, sf_dir):
    rows = activity.windowed(graphs.user_activity(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    return rows.withColumn("start", F.col("start").cast("date"))
