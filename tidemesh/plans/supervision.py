"""Queries of phases, supervision, adjustment and clusters, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phase, planning, propagation, retrieval, series, supervision, topology, validation
from ..sources import graphs
from ..sources.graphs import CO_SUPPLY, TRADE, table
from .catalogue import _DAILY, _LAYERED, _ORDER, _PART, _STATE, _daily, _day, _labels, _mapped, _regions, _spread_sql, _users, query


def rounded(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})


_DAYS = """days AS (SELECT event_type AS run, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS speed, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS dist,
  CAST(count(DISTINCT user_id) AS DOUBLE) AS tension, CASE WHEN day(CAST(ts AS DATE)) % 7 <> 0 THEN CAST(max(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) END AS objective FROM events GROUP BY event_type, CAST(ts AS DATE)),
padded AS (SELECT run, day, speed, dist, tension, coalesce(last_value(objective IGNORE NULLS) OVER (PARTITION BY run ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS objective FROM days)"""


def _days(spark, sf_dir):
    """Four series a type of event, day by day; the objective is missing every seventh day of a month."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = graphs.user_activity(spark, sf_dir).groupBy(F.col("event_type").alias("run"), F.col("ts").cast("date").alias("day")).agg(
        F.count("*").cast("double").alias("speed"), (F.sum(cents) / F.count("*")).alias("dist"), F.countDistinct("user_id").cast("double").alias("tension"), F.max(cents).cast("double").alias("objective"))
    rows = rows.withColumn("objective", F.when(F.dayofmonth("day") % 7 != 0, F.col("objective")))
    return phase.padded(rows, "run", ["day"], ["objective"])


@query(f"WITH {_DAYS} SELECT run, day, objective FROM padded")
def padded_series(spark, sf_dir):
    return _days(spark, sf_dir).select("run", "day", "objective")


_UNIT = "greatest(0, least(1, {}))".format
_NORMAL = ", ".join(f"CASE WHEN max({c}) OVER r - min({c}) OVER r <= 1e-9 THEN 0 ELSE ({c} - min({c}) OVER r) / (max({c}) OVER r - min({c}) OVER r) END AS {c}" for c in ("speed", "dist", "tension", "objective"))
_PHASES = f"""{_DAYS}, normal AS (SELECT run, day, {_NORMAL} FROM padded WINDOW r AS (PARTITION BY run)),
x AS (SELECT *, 0.45 * speed + 0.35 * dist + 0.2 * tension AS x FROM normal),
l AS (SELECT *, CASE WHEN x < 0.33 THEN 'calm' WHEN x < 0.66 THEN 'adaptive' ELSE 'turbulent' END AS label, row_number() OVER w AS i, x - lag(x) OVER w AS d, lag(x) OVER w AS y, objective - lag(objective) OVER w AS o, dist - lag(dist) OVER w AS e,
  tension - lag(tension) OVER w AS t, var_pop(x) OVER (PARTITION BY run ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM x WINDOW w AS (PARTITION BY run ORDER BY day)),
moved AS (SELECT run, sign(d) <> lag(sign(d)) OVER (PARTITION BY run ORDER BY day) AS turned FROM l WHERE abs(d) > 1e-9), flips AS (SELECT run, coalesce(avg(CAST(turned AS INT)), 0) AS flip_rate FROM moved GROUP BY 1),
isle AS (SELECT run, label, i, i - row_number() OVER (PARTITION BY run, label ORDER BY i) AS k FROM l), spell AS (SELECT run, label, k, count(*) AS n FROM isle GROUP BY ALL), longest AS (SELECT run, max(n) AS longest FROM spell GROUP BY 1),
main AS (SELECT run, label, n FROM (SELECT run, label, count(*) AS n, row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, min(i)) AS r FROM l GROUP BY 1, 2) WHERE r = 1),
switched AS (SELECT run, CAST(coalesce(sum(CAST(c AS INT)), 0) AS BIGINT) AS switches FROM (SELECT run, label <> lag(label) OVER (PARTITION BY run ORDER BY i) AS c FROM l) GROUP BY 1),
signs AS (SELECT *, CAST(d > 1e-9 AS INT) + CAST(o > 1e-9 AS INT) + CAST(t > 1e-9 AS INT) AS p, CAST(d < -1e-9 AS INT) + CAST(o < -1e-9 AS INT) + CAST(t < -1e-9 AS INT) AS m FROM l WHERE i > 1),
agree AS (SELECT run, avg(CASE WHEN p + m = 0 THEN 1 ELSE greatest(p, m) / CAST(p + m AS DOUBLE) END) AS coherence, avg(CASE WHEN d * o < 0 THEN 1.0 ELSE 0 END) AS hysteresis, sum(CASE WHEN e * o < 0 THEN 1 ELSE 0 END + CASE WHEN o * t < 0 THEN 0.5 ELSE 0 END) AS bad,
  max(abs(d)) AS jump, avg(abs(o)) AS moves, corr(x, y) AS r, arg_max(abs(d), i) AS d1 FROM signs GROUP BY 1),
ends AS (SELECT run, count(*) AS n, var_pop(x) AS var, arg_min(v, i) FILTER (WHERE i >= 3) AS v3, arg_max(v, i) AS local, arg_max(tension, i) AS ten, arg_max(abs(y - lag_y), i) AS d2 FROM (SELECT *, lag(y) OVER (PARTITION BY run ORDER BY i) AS lag_y FROM l) GROUP BY 1),
a AS (SELECT *, 0.65 * (r + 1) / 2 + 0.35 * least(1, 4 * greatest(0, local - v3)) AS slowing, least(1, bad / (1.5 * (n - 1))) AS broken, 0.6 * longest / n + 0.4 * main.n / ends.n AS persistence
  FROM agree JOIN ends USING (run) JOIN flips USING (run) JOIN longest USING (run) JOIN switched USING (run) JOIN (SELECT run, label, n AS mn FROM main) m2 USING (run) JOIN main USING (run, label)),
phases AS (SELECT *, {_UNIT("0.35 * jump + 0.19 * var + 0.14 * moves + 0.12 * least(1, slowing) + 0.08 * hysteresis + 0.07 * flip_rate + 0.05 * (1 - coherence)")} AS critical,
  {_UNIT("CASE WHEN greatest(d1, d2) > 0.12 THEN least(0.5, greatest(d1, d2)) ELSE 0 END + CASE WHEN local > 0.03 THEN least(0.3, 2 * local) ELSE 0 END + CASE WHEN ten > 0.65 THEN 0.2 ELSE 0 END + least(0.15, 0.25 * flip_rate) + least(0.1, 0.2 * (1 - coherence))")} AS warning FROM a)"""
_PHASES = _PHASES.replace("0.4 * main.n / ends.n AS persistence", "0.4 * mn / n AS persistence").replace("JOIN (SELECT run, label, n AS mn FROM main) m2 USING (run) JOIN main USING (run, label)", "JOIN (SELECT run, label, n AS mn FROM main) m2 USING (run)")


@query(f"""WITH {_PHASES} SELECT run, n, switches, round(persistence, 6) AS persistence, round(flip_rate, 6) AS flip_rate, round(coherence, 6) AS coherence, round(broken, 6) AS broken, round(hysteresis, 6) AS hysteresis,
  round(least(1, slowing), 6) AS slowing, round(critical, 6) AS critical, round(warning, 6) AS warning, CASE WHEN critical >= 0.6 THEN 'critical' ELSE label END AS regime FROM phases""")
def phase_analysis(spark, sf_dir):
    rows = phase.analysis(_days(spark, sf_dir), "run", ["day"])
    return rounded(rows, "persistence", "flip_rate", "coherence", "broken", "hysteresis", "slowing", "critical", "warning")


@query(f"""WITH {_PHASES} SELECT run, round({_UNIT("0.48 * critical + 0.27 * warning + 0.13 * broken + 0.08 * flip_rate + 0.04 * (1 - coherence)")}, 6) AS risk FROM phases""")
def phase_risk(spark, sf_dir):
    rows = phase.analysis(_days(spark, sf_dir), "run", ["day"])
    return rows.select("run", F.round(supervision.phase_risk(*map(F.col, ("critical", "warning", "broken", "flip_rate", "coherence"))), 6).alias("risk"))


@query(f"""WITH {_DAYS}, s AS (SELECT run, row_number() OVER w AS i, count(*) OVER (PARTITION BY run) AS n, abs(dist - lag(dist) OVER w) / 100 AS d, abs(objective - lag(objective) OVER w) / 100 AS o, abs(lag(objective) OVER w - lag(objective, 2) OVER w) / 100 AS p FROM padded WINDOW w AS (PARTITION BY run ORDER BY day))
SELECT run, coalesce(o <= 0.01 AND p <= 0.01, false) AS flat, coalesce(d < 0.02, false) AS still FROM s WHERE i = n""")
def settled_runs(spark, sf_dir):
    rows = _days(spark, sf_dir).withColumns({c: F.col(c) / 100 for c in ("dist", "objective")})
    return phase.settled(rows, "run", ["day"], "dist", "objective")


@query("""WITH r AS (SELECT user_id, value AS x, first_value(value) OVER w AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, abs(value - lag(value) OVER w) AS s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), a AS (SELECT user_id, any_value(f) AS f, any_value(l) AS l, coalesce(sum(s), 0) AS p, count(*) AS n FROM r GROUP BY 1)
SELECT user_id, round(greatest(0, least(1, (f - l) / greatest(1e-6, abs(f)))), 6) AS rate, round(CASE WHEN n < 2 OR p <= 1e-9 THEN 1 ELSE least(1, abs(f - l) / p) END, 6) AS efficiency FROM a""")
def recovery(spark, sf_dir):
    return rounded(series.recovery(series.resilience(_labels(spark, sf_dir), "user_id", _ORDER, "value", block=_day()), "user_id"), "rate", "efficiency")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS b FROM events GROUP BY 1, 2)
SELECT user_id, round(avg(abs(a - b)), 6) AS hysteresis FROM d WHERE a > 0 AND b > 0 GROUP BY 1""")
def hysteresis_index(spark, sf_dir):
    """Clicks against views of a user, over the days that have both."""
    per = lambda kind: graphs.user_activity(spark, sf_dir).where(F.col("event_type") == kind).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").cast("double").alias("x"))
    return rounded(series.hysteresis(per("click"), per("view"), "user_id", "day"), "hysteresis")


@query("""WITH d AS (SELECT user_id, abs(value - 50) AS d, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50)) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(d, 6) AS radius FROM d WHERE i = round_even((n - 1) * CAST(0.9 AS DOUBLE), 0) + 1""")
def quantile_radius(spark, sf_dir):
    rows = graphs.user_activity(spark, sf_dir).select("user_id", F.abs(F.col("value") - 50).alias("d"))
    return rounded(series.quantile_radius(rows, "user_id", 0.9), "radius")


_SIMPLE = "simple AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM trade WHERE src <> dst), adj AS (SELECT u AS node, v AS nbr FROM simple UNION ALL SELECT v, u FROM simple)"
_CLUSTER = "c AS (SELECT n_name AS node, r_name AS cluster, n_nationkey / CAST(25 AS DOUBLE) - 0.3 AS impact FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {TRADE}, {_SIMPLE}, {_CLUSTER}, m AS (SELECT cluster, avg(impact) AS m FROM c GROUP BY 1), t AS (SELECT max(m) AS a, (SELECT m FROM m ORDER BY m DESC LIMIT 1 OFFSET 1) AS b FROM m),
n AS (SELECT adj.node, c.cluster, count(*) AS n FROM adj JOIN c ON adj.nbr = c.node GROUP BY ALL), p AS (SELECT n, sum(n) OVER (PARTITION BY node) AS d, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY node) AS p FROM n),
e AS (SELECT greatest(0, least(1, sum(-p * ln(p + 1e-12) * d) / (sum(n) * ln((SELECT count(DISTINCT cluster) FROM c))))) AS mixing FROM p), g AS (SELECT greatest(0, least(1, (a - b) / (abs(a) + abs(b) + 1e-9))) AS margin FROM t)
SELECT round(margin, 6) AS margin, round(mixing, 6) AS mixing, round(0.55 * (1 - margin) + 0.45 * mixing, 6) AS confusion FROM e, g""")
def confusion(spark, sf_dir):
    edges = graphs.trade(spark, sf_dir).select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    both = edges.unionByName(edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr")))
    impact = table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), (F.col("n_nationkey") / F.lit(25.0) - 0.3).alias("impact"))
    return rounded(supervision.confusion(both, _regions(spark, sf_dir), impact), "margin", "mixing", "confusion")


_WAVE = "(node % 7 - 3) / CAST(3 AS DOUBLE)"


def _wave(nodes, name="node"):
    """A shock that is given by the key: -1 to 1."""
    return nodes.withColumn("impact", (F.col(name) % 7 - 3) / F.lit(3.0))


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))


@query(f"""WITH RECURSIVE {CO_SUPPLY}, k AS (SELECT node FROM (SELECT s_suppkey AS node FROM supplier) ORDER BY abs({_WAVE}) DESC, node LIMIT (SELECT greatest(1, CAST(round_even(count(*) * CAST(0.1 AS DOUBLE), 0) AS BIGINT)) FROM supplier)),
inner_ AS (SELECT node, nbr FROM adj WHERE node IN (FROM k) AND nbr IN (FROM k)), reach AS (SELECT DISTINCT node, node AS peer FROM inner_ UNION SELECT reach.node, inner_.nbr FROM reach JOIN inner_ ON reach.peer = inner_.node),
comp AS (SELECT node, min(peer) AS c FROM reach GROUP BY 1), big AS (SELECT coalesce(max(n), 1) AS big FROM (SELECT count(*) AS n FROM comp GROUP BY c)), a AS (SELECT count(*) AS n, count(*) FILTER (WHERE node IN (SELECT node FROM adj)) AS held FROM k),
f AS (SELECT 1 - CAST(held AS DOUBLE) / n AS loss, CASE WHEN n <= 1 THEN 1 ELSE CAST(big AS DOUBLE) / n END AS connectivity FROM a, big)
SELECT round(loss, 6) AS loss, round(connectivity, 6) AS connectivity, round(greatest(0, least(1, 0.6 * loss + 0.4 * greatest(0, 1 - connectivity))), 6) AS forgetting FROM f""")
def forgetting(spark, sf_dir):
    nodes = _suppliers(spark, sf_dir)
    chosen = supervision.important(nodes, _wave(nodes), nodes.count(), 0.1)
    rows = supervision.forgetting(chosen, graphs.both_ways(graphs.co_supply(spark, sf_dir)), 1.0)
    return rounded(rows, "loss", "connectivity", "forgetting")


_RATE = "CAST(0.205 AS DOUBLE)"  # 0.25 * (1 - 0.6 * 0.3)
_SHIFT = f"""e AS (SELECT u, v, weight / CAST(4 AS DOUBLE) AS weight, {_WAVE.replace("node", "u")} AS a, {_WAVE.replace("node", "v")} AS b FROM pairs),
p AS (SELECT *, 0.65 * (a + b) / 2 + 0.35 * CASE WHEN a * b >= 0 THEN 1 ELSE -1 END * least(abs(a), abs(b)) AS p FROM e),
s AS (SELECT *, greatest(0.05, least(5, weight + {_RATE} * (0.22 * p + 0.1 * 0.4 - 0.08 * 0.2 - 0.1 * 0.3) - CASE WHEN abs(p) < 0.08 THEN {_RATE} * 0.04 ELSE 0 END)) AS after FROM p),
changed AS (SELECT *, after - weight AS shift, CASE WHEN after - weight > 1e-6 THEN 1 WHEN after - weight < -1e-6 THEN -1 ELSE 0 END AS change FROM s)"""


def _reweighted(spark, sf_dir):
    pairs = graphs.co_supply(spark, sf_dir).withColumn("weight", F.col("weight") / 4)
    return supervision.reweighted(pairs, _wave(_suppliers(spark, sf_dir)), 0.3, 0.4, 0.2)


@query(f"WITH {CO_SUPPLY}, {_SHIFT} SELECT u, v, weight, round(after, 6) AS after, change FROM changed")
def reweight_edges(spark, sf_dir):
    return _reweighted(spark, sf_dir).drop("shift")


@query(f"WITH {CO_SUPPLY}, {_SHIFT} SELECT count(*) FILTER (WHERE change > 0) AS gained, count(*) FILTER (WHERE change < 0) AS lost, count(*) FILTER (WHERE change = 0) AS same, round(avg(abs(shift)), 6) AS mean_shift FROM changed")
def reweight_shift(spark, sf_dir):
    return rounded(supervision.shifts(_reweighted(spark, sf_dir)), "mean_shift")


@query(f"""WITH {_LAYERED}, {_STATE}, k AS (SELECT entity, least(1, h / 2) AS c, least(1, CAST(temporal AS DOUBLE) / edges) AS f, least(1, CAST(layers AS DOUBLE) / edges * 10) AS s, 1 - least(1, CAST(spatial AS DOUBLE) / edges) AS co FROM state JOIN lay USING (entity) JOIN ent USING (entity)),
p AS (SELECT *, greatest(0, least(1, 0.7 * s + 0.3 * (1 - co))) AS z FROM k), q AS (SELECT *, least(0.95, 0.62 + 0.2 * c + 0.12 * z) AS t_on, greatest(0.3, 1 - 0.6 * c - 0.25 * z) AS nb, greatest(0.2, 1 - 0.75 * f - 0.15 * z) AS db FROM p)
SELECT entity, round(z, 6) AS shaken, round(greatest(0.01, 0.28 * (1 - 0.45 * c) * (1 - 0.35 * z)), 6) AS eta_up, round(greatest(0.01, 0.1 * (1 + 0.6 * f)), 6) AS eta_down, round(t_on, 6) AS theta_on, round(greatest(0.05, least(t_on - 0.05, 0.34 + 0.12 * c)), 6) AS theta_off,
  round(greatest(0.25, least(1.25, (1 - 0.65 * c) * (1 + 0.35 * f) * (1 - 0.4 * z))), 6) AS budget, round(nb, 6) AS new_bias, round(db, 6) AS drop_bias, round(greatest(0, least(1, db / (db + nb + 1e-9))), 6) AS drop_share, CAST(2 + CASE WHEN c > 0.65 OR z > 0.6 THEN 1 ELSE 0 END AS INT) AS dwell FROM q""")
def supervisory_policy(spark, sf_dir):
    """What a policy would be for every user, with measures of the user's state in place of confusion and the others."""
    rows = _users(spark, sf_dir).select("entity", (F.col("social_entropy") / 2).alias("confusion"), F.col("temporal_regularity").alias("forgetting"), (F.col("transition_speed") * 10).alias("flip_rate"), (1 - F.col("spatial_range") / F.col("schedule_density")).alias("coherence"))
    rows = supervision.policy(rows).drop("confusion", "forgetting", "flip_rate", "coherence")
    return rounded(rows, *[c for c in rows.columns if c not in ("entity", "dwell")])


@query(f"""WITH {_DAILY}, k AS (SELECT user_id, avg(regularity) AS r, avg(speed) AS s, avg(density) AS d, count(*) AS n FROM daily GROUP BY 1),
t AS (SELECT user_id, greatest(0, least(1, 0.55 * r + 0.04 * d)) AS viscosity, greatest(0, 0.7 * s + 0.3 * r - 0.25 * r) AS instability, greatest(0, least(1, 0.45 * r + 0.3 * least(1, d / 2) + 0.25 * least(1, s / 3))) AS coupling, least(1, s) AS density, least(1, d / 10) AS noise, r AS risk, s / 10 AS shift, n % 4 AS edits FROM k),
c AS (SELECT *, (0.38 + 0.22 * density) * shift AS churn, (0.28 + 0.28 * noise) * greatest(0, instability - viscosity) AS volatility, (0.03 + 0.08 * density) * edits AS rewiring, (0.28 + 0.22 * least(1, risk)) * risk AS risk_cost, (0.2 + 0.2 * noise) * coupling AS coupling_cost FROM t)
SELECT user_id, round(viscosity + 1e-9, 4) AS viscosity, round(instability + 1e-9, 4) AS instability, round(coupling + 1e-9, 4) AS coupling, round(churn + 1e-9, 4) AS churn, round(volatility + 1e-9, 4) AS volatility, round(rewiring + 1e-9, 4) AS rewiring, round(risk_cost + 1e-9, 4) AS risk_cost, round(coupling_cost + 1e-9, 4) AS coupling_cost,
  round(churn + volatility + rewiring + risk_cost + coupling_cost + 1e-9, 4) AS total FROM c""")
def plan_objective(spark, sf_dir):
    per = _daily(spark, sf_dir).groupBy("user_id").agg(F.avg("regularity").alias("r"), F.avg("speed").alias("s"), F.avg("density").alias("d"), F.count("*").alias("n"))
    r, s, d = F.col("r"), F.col("s"), F.col("d")
    rows = per.select("user_id", supervision.viscosity(r, d).alias("viscosity"), supervision.instability(s, r, r).alias("instability"), supervision.coupling(r, d, s).alias("coupling"), s.alias("density"), (d / 10).alias("noise"), r.alias("risk"), (s / 10).alias("shift"), (F.col("n") % 4).alias("edits"))
    rows = supervision.objective(rows).drop("density", "noise", "risk", "shift", "edits")
    return rows.select("user_id", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in rows.columns if c != "user_id"])  # ties of exact halves fall alike


@query(f"""WITH {CO_SUPPLY}, top AS (SELECT node, {_WAVE} AS i FROM (SELECT s_suppkey AS node FROM supplier) ORDER BY abs(i) DESC, node LIMIT 12), near AS (SELECT node, count(*) AS d, sum({_WAVE.replace("node", "nbr")}) AS s FROM adj WHERE node IN (SELECT node FROM top) GROUP BY 1),
n AS (SELECT top.node, i, coalesce(d, 0) AS d, coalesce(s, 0) / greatest(1, coalesce(d, 0)) AS m FROM top LEFT JOIN near USING (node)), c AS (SELECT x.node AS u, y.node AS v, count(*) AS c FROM adj x JOIN adj y ON x.nbr = y.nbr AND x.node < y.node GROUP BY 1, 2),
p AS (SELECT a.node AS u, b.node AS v, a.i AS ia, b.i AS ib, (a.i * b.i + a.d * b.d + a.m * b.m) / nullif(sqrt(a.i ** 2 + a.d ** 2 + a.m ** 2) * sqrt(b.i ** 2 + b.d ** 2 + b.m ** 2), 0) AS cos, a.d + b.d AS dd FROM n a JOIN n b ON a.node < b.node WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.u = a.node AND pairs.v = b.node)),
q AS (SELECT p.u, p.v, coalesce(cos, 0) AS cos, CASE WHEN dd - coalesce(c, 0) = 0 THEN 0 ELSE 1 - CAST(coalesce(c, 0) AS DOUBLE) / (dd - coalesce(c, 0)) END AS bridge, greatest(0, least(1, 1 - abs(ia - ib) / greatest(1e-6, abs(ia) + abs(ib)))) AS st FROM p LEFT JOIN c USING (u, v))
SELECT u, v, round(0.7 * (0.55 * cos + 0.45 * bridge) + 0.3 * (0.7 * cos + 0.3 * st), 6) AS score FROM q ORDER BY round(0.7 * (0.55 * cos + 0.45 * bridge) + 0.3 * (0.7 * cos + 0.3 * st), 9) DESC, u, v LIMIT 3""")
def suggest_new_edges(spark, sf_dir):
    """Three pairs: round(3 * (1 - 0.75 * 0.3) * (1 + 0.4 * (1 - 0.3)))."""
    rows = supervision.new_edges(_wave(_suppliers(spark, sf_dir)), graphs.both_ways(graphs.co_supply(spark, sf_dir)), 0.3, 0.3)
    return rounded(rows, "score")


@query(f"""WITH {CO_SUPPLY}, d AS (SELECT node, count(*) AS d FROM adj GROUP BY 1), c AS (SELECT p.u, p.v, count(y.nbr) AS common FROM pairs p JOIN adj x ON x.node = p.u LEFT JOIN adj y ON y.node = p.v AND y.nbr = x.nbr GROUP BY 1, 2)
SELECT u, v, common, round(CAST(common AS DOUBLE) / (a.d + b.d - common), 6) AS jaccard FROM c JOIN d a ON u = a.node JOIN d b ON v = b.node""")
def neighbour_jaccard(spark, sf_dir):
    return rounded(topology.neighbour_jaccard(graphs.co_supply(spark, sf_dir)), "jaccard")


@query(f"""WITH {CO_SUPPLY}, w AS (SELECT max(weight) AS m FROM pairs), d AS (SELECT node, sum(weight) AS w, count(*) AS d, avg({_WAVE.replace("node", "nbr")}) AS a FROM adj GROUP BY 1),
t AS (SELECT x.node, sum(cbrt(x.weight / CAST(m AS DOUBLE) * (y.weight / CAST(m AS DOUBLE)) * (z.weight / CAST(m AS DOUBLE)))) AS r FROM adj x JOIN adj y ON x.node = y.node AND x.nbr < y.nbr JOIN pairs z ON z.u = x.nbr AND z.v = y.nbr, w GROUP BY 1)
SELECT node, round({_WAVE}, 6) AS impact, round(ln(1 + w), 6) AS degree, round(CASE WHEN d > 1 THEN 2 * coalesce(r, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering, CASE WHEN abs(a) < 1e-12 THEN 0 ELSE round(a, 6) END AS around FROM d LEFT JOIN t USING (node)""")
def node_features(spark, sf_dir):
    rows = topology.node_features(graphs.co_supply(spark, sf_dir), _wave(_suppliers(spark, sf_dir)))
    return rounded(rows, "impact", "degree", "clustering", "around")


@query(f"""WITH {CO_SUPPLY}, s AS (SELECT s_suppkey AS node FROM supplier), c AS (SELECT node, lead(node) OVER (PARTITION BY node % 5 ORDER BY abs({_WAVE}) DESC, node) AS next FROM s), e AS (SELECT u, v, 0.65 * CAST(weight AS DOUBLE) / (SELECT max(weight) FROM pairs) AS w FROM pairs
  UNION ALL SELECT least(node, next), greatest(node, next), 0.16 FROM c WHERE next IS NOT NULL) SELECT u, v, round(sum(w), 6) AS weight FROM e GROUP BY 1, 2""")
def hybrid_graph(spark, sf_dir):
    nodes = _suppliers(spark, sf_dir)
    rows = topology.hybrid_edges(graphs.co_supply(spark, sf_dir), nodes.withColumn("cluster", F.col("node") % 5), _wave(nodes))
    return rounded(rows, "weight")


@query(_PART + """, p AS (SELECT coalesce(triangles, 0) AS t, coalesce(cliques, 0) AS q FROM nodes LEFT JOIN t USING (node) LEFT JOIN q USING (node))
SELECT round((sum(t) / 3.0 + 2 * sum(q) / 4.0) / count(*), 6) AS density, round(var_pop(t + 1.5 * q), 4) AS tension FROM p""")
def simplex_tension(spark, sf_dir):
    pairs = graphs.co_supply(spark, sf_dir)
    three = topology.triangles(pairs)
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rows = topology.simplex_tension(topology.participation(nodes, three, topology.four_cliques(three, pairs)))
    return rows.select(F.round("density", 6).alias("density"), F.round("tension", 4).alias("tension"))


_IMPACT = "imp AS (SELECT n_name AS node, CAST(n_nationkey AS DOUBLE) / 25 AS i FROM nation)"
_FLOW = f"{_IMPACT}, f AS (SELECT src, dst, b.i - a.i + 0.05 * weight AS f FROM trade JOIN imp a ON src = a.node JOIN imp b ON dst = b.node), s AS (SELECT node, sum(abs(f)) AS s FROM (SELECT src AS node, f FROM f UNION ALL SELECT dst, f FROM f) GROUP BY 1), pr AS (SELECT node, s / greatest(1, (SELECT max(s) FROM s)) AS pressure FROM s)"


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), (F.col("n_nationkey").cast("double") / 25).alias("impact"))


def _pressed(spark, sf_dir):
    impact = _nations(spark, sf_dir)
    at = lambda x: impact.select(F.col("node").alias(x), F.col("impact").alias("i_" + x))
    flows = graphs.trade(spark, sf_dir).select("src", "dst", "weight").join(at("src"), "src").join(at("dst"), "dst")
    return topology.flow_pressure(flows.select("src", "dst", (F.col("i_dst") - F.col("i_src") + 0.05 * F.col("weight")).alias("flow")))


@query(f"WITH {TRADE}, {_FLOW} SELECT node, round(pressure, 6) AS pressure FROM pr")
def flow_pressure(spark, sf_dir):
    return rounded(_pressed(spark, sf_dir), "pressure")


_CONTROL = f"""{_FLOW}, k AS (SELECT node, i, greatest(-0.895, least(0.895, -0.35 * (i - 0.5) - 0.15 * i - 0.2 * (0.6 - 0.45) - 0.12 * i * i - 0.1 * i - 0.18 * pressure - 0.16 * (1 - pressure))) AS u FROM pr JOIN imp USING (node))"""


def _controlled(spark, sf_dir):
    i = F.col("impact")
    rows = _pressed(spark, sf_dir).join(_nations(spark, sf_dir), "node").select("node", "impact", (i - 0.5).alias("div"), i.alias("phi"), (i * i).alias("cycle"), i.alias("higher"), F.col("pressure").alias("curl"), (1 - F.col("pressure")).alias("harmonic"))
    return supervision.node_control(rows, 0.3, 0.6)


@query(f"WITH {TRADE}, {_CONTROL} SELECT node, round(u, 4) AS control, round(greatest(-10, least(10, i + round(u, 6))), 4) AS controlled, abs(round(u, 6)) >= 0.98 * 0.895 AS saturated FROM k")
def node_control(spark, sf_dir):
    return _controlled(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("control", "controlled")})


@query(f"WITH {TRADE}, {_CONTROL} SELECT round(sum(u * u), 4) AS energy, round(avg(CASE WHEN abs(u) >= 0.98 * 0.895 THEN 1.0 ELSE 0 END), 4) AS saturation FROM k")
def control_cost(spark, sf_dir):
    return supervision.control_cost(_controlled(spark, sf_dir)).select(F.round("energy", 4).alias("energy"), F.round("saturation", 4).alias("saturation"))


@query(f"""WITH {TRADE} SELECT least(src, dst) AS u, greatest(src, dst) AS v, CAST(arg_max(polarity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)) AS INT) AS polarity FROM trade GROUP BY 1, 2""")
def edge_polarity(spark, sf_dir):
    return supervision.polarity(graphs.trade(spark, sf_dir))


@query("""SELECT n_name AS node, round(1.5 * coalesce(try_cast(CASE n_nationkey % 3 WHEN 0 THEN 'x' || n_nationkey WHEN 1 THEN NULL ELSE CAST(n_nationkey AS VARCHAR) END AS DOUBLE), 1), 6) AS impact FROM nation""")
def seed_strengths(spark, sf_dir):
    key = F.col("n_nationkey")
    weight = F.when(key % 3 == 0, F.concat(F.lit("x"), key)).when(key % 3 == 2, key.cast("string"))
    return rounded(supervision.seeds(table(spark, sf_dir, "nation").select(F.col("n_name").alias("target"), weight.alias("weight")), 1.5), "impact")


_PUSH = "greatest(0, least(2, c_acctbal / 1000)) * greatest(-1, least(1, (c_custkey % 9 - 4) / CAST(3 AS DOUBLE)))"
_FACTORS = {"social_entropy": 0.10, "temporal_regularity": -0.12, "spatial_range": 0.05, "schedule_density": 0.18, "network_centrality": 0.08, "transition_speed": 0.22}


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN {_PUSH} = 0 THEN 0 ELSE round({f} * {_PUSH}, 6) END AS {n}" for n, f in _FACTORS.items()) + " FROM customer")
def shock_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    rows = rows.select("c_custkey", *supervision.shock(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 9 - 4) / F.lit(3.0)))
    return rounded(rows, *[c for c in rows.columns if c != "c_custkey"])


@query(f"""WITH {TRADE}, more AS (SELECT *, l_orderkey || ':' || l_linenumber AS id FROM trade UNION ALL SELECT *, l_orderkey || ':' || l_linenumber FROM trade WHERE l_linenumber = 7),
d AS (SELECT count(*) - count(DISTINCT id) AS n FROM more), g AS (SELECT count(DISTINCT id) AS n FROM more WHERE src NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 20) OR dst NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 20))
SELECT 'duplicate_interaction_id' AS code, n FROM d UNION ALL SELECT 'dangling_edge_node', n FROM g UNION ALL SELECT 'graph_id_missing', 1 UNION ALL SELECT 'schema_missing', 1""")
def validate_broken_graph(spark, sf_dir):
    """Line items 7 stand twice, five nations are unknown, and the graph has no name and no version."""
    times = F.when(F.col("l_linenumber") == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    edges = graphs.trade(spark, sf_dir).withColumn("time", F.explode(times)).drop("time").withColumn("edge_id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    nodes = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("id"))
    found = validation.issues(edges, nodes, graph_id=" ", schema_version="", block=F.expr("l_orderkey div 1048576"))
    codes = ["duplicate_interaction_id", "dangling_edge_node", "graph_id_missing", "schema_missing"]
    return found.where(F.col("code").isin(codes)).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS records, 2 AS edge_rules, 2 AS node_fields, CAST(0 AS BIGINT) AS errors, true AS valid FROM orders")
def adapter_build(spark, sf_dir):
    """Records mapped to a graph, checked and reported in one go."""
    records, nodes, edges = _mapped(spark, sf_dir)
    edges = edges.select(F.concat_ws(":", "at.o_orderkey", "rule").alias("edge_id"), F.struct("at", "rule").alias("ord"), "src", "dst", "layer", "weight", F.lit(0).alias("ts"))
    return validation.report(records, {"who": "customer", "what": "priority"}, ["orders", "status"], validation.issues(edges, nodes))


@query("SELECT doc_id AS id, CASE WHEN reason IS NULL THEN claim ELSE '' END AS claim, CASE WHEN reason IS NULL THEN CAST(0.2 AS DOUBLE) ELSE 1 END AS uncertainty, reason FROM (SELECT doc_id, source AS claim, CASE " + " ".join(f"WHEN contains(lower(coalesce(source, '')), '{w}') THEN '{w}'" for w in retrieval.BLOCKED) + " END AS reason FROM documents)")
def guarded_answers(spark, sf_dir):
    return retrieval.answer(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("claim"), F.lit(0.2).alias("uncertainty")))


@query("SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 5")
def top_balances(spark, sf_dir):
    return retrieval.top_k(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"], 5, absolute=True)


@query(f"""WITH {_spread_sql("1")[5:]}, f AS (SELECT 'spread' AS method, node FROM s3 ORDER BY round(impact, 9) DESC, node LIMIT 3), b AS (SELECT node, count(DISTINCT nbr) AS d FROM adj GROUP BY 1), g AS (SELECT 'degree' AS method, node FROM b ORDER BY d DESC, node LIMIT 3),
x AS (SELECT s_suppkey AS node FROM supplier ORDER BY s_suppkey LIMIT 3), y AS (SELECT method, count(x.node) AS h, count(*) AS n FROM (FROM f UNION ALL FROM g) LEFT JOIN x USING (node) GROUP BY 1) SELECT method, round(h / CAST(3 AS DOUBLE), 4) AS recall, round(h / CAST(n AS DOUBLE), 4) AS precision FROM y""")
def predictor_recall(spark, sf_dir):
    adj = graphs.both_ways(graphs.co_supply(spark, sf_dir))
    deg = retrieval.degrees(adj)
    seed = deg.orderBy(F.desc("simple"), "node").limit(1).select("node", F.lit(1.0).alias("impact"))
    spread = propagation.spread(seed, adj.withColumn("polarity", F.lit(1))).orderBy(F.desc(F.round("impact", 9)), "node").limit(3)
    named = lambda rows, name: rows.select(F.lit(name).alias("method"), F.lit(1).alias("scenario"), "node")
    predicted = named(spread, "spread").unionByName(named(deg.orderBy(F.desc("simple"), "node").limit(3), "degree"))
    return supervision.recall(predicted, _suppliers(spark, sf_dir).orderBy("node").limit(3).select(F.lit(1).alias("scenario"), "node"))


@query(f"""WITH {CO_SUPPLY}, i AS (SELECT DISTINCT node, {_WAVE} AS n, {_WAVE.replace("node", "(node + 2)")} AS p FROM adj), j AS (SELECT u, v, (u + v) % 10 / CAST(10 AS DOUBLE) AS aff, a.n AS na, b.n AS nb, a.p AS pa, b.p AS pb FROM pairs JOIN i a ON u = a.node JOIN i b ON v = b.node),
e AS (SELECT *, 0.22 * (0.7 * greatest(-1, least(1, na * nb)) + 0.3 * greatest(-1, least(1, pa * nb - pb * na))) AS e FROM j),
a AS (SELECT *, greatest(0, least(1, aff + 0.28 * greatest(0, e) * 0.81 * 0.9 - 0.1 * greatest(0, -e))) AS a FROM e)
SELECT u, v, round(a, 6) AS affinity, round(e, 6) AS eligibility, CASE WHEN a >= 0.62 THEN 1 ELSE 0 END AS "on", CASE WHEN a <= 0.34 THEN 1 ELSE 0 END AS "off" FROM a""")
def plasticity_step(spark, sf_dir):
    """One step from given affinities; every node has a budget of 0.9, and the risk is 0.2."""
    pairs = graphs.co_supply(spark, sf_dir).select("u", "v", ((F.col("u") + F.col("v")) % 10 / F.lit(10.0)).alias("affinity"), F.lit(0.0).alias("eligibility"), F.lit(0).alias("on"), F.lit(0).alias("off"))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    signals = _wave(nodes).select("node", F.col("impact").alias("now"), (((F.col("node") + 2) % 7 - 3) / F.lit(3.0)).alias("before"))
    after, _ = supervision.plasticity(pairs, signals, nodes.withColumn("budget", F.lit(0.9)), 0.2)
    return rounded(after, "affinity", "eligibility")


@query(f"""WITH {CO_SUPPLY}, e AS (SELECT u, v, weight, (u % 7 - 3) / CAST(3 AS DOUBLE) AS a, (v % 7 - 3) / CAST(3 AS DOUBLE) AS b FROM pairs),
g AS (SELECT *, abs(a) + abs(b) AS mass, abs(a - b) / greatest(1e-6, abs(a) + abs(b)) AS gap, CASE WHEN a * b >= 0 THEN 1 ELSE 0 END AS same FROM e), h AS (SELECT *, greatest(0, 1 - gap) AS stab FROM g)
SELECT u, v, weight, round(weight + 0.375 * (0.5 * mass) / (1 + 0.5 * mass) * (0.55 * stab + 0.45 * same) - 0.23 * (1 - same) * (0.5 + 0.5 * (1 - stab)) - 0.04 * gap, 9) AS score FROM h ORDER BY round(weight + 0.375 * (0.5 * mass) / (1 + 0.5 * mass) * (0.55 * stab + 0.45 * same) - 0.23 * (1 - same) * (0.5 + 0.5 * (1 - stab)) - 0.04 * gap, 9), u, v LIMIT 2""")
def suggest_drops(spark, sf_dir):
    """Two edges: round(3 * (1 - 0.7 * 0.5) * (0.7 + 0.6 * 0.5))."""
    return planning.drops(graphs.co_supply(spark, sf_dir), _wave(_suppliers(spark, sf_dir)), 0.5, 0.5)
