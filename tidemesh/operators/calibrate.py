"""A calibration as a whole: every candidate's cycles over every scenario, their measures, scores and the best share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.tables import saved, scratch
from . import calibration, cycles
from .planning import clip

#: Cycles after the prediction, each from the graph that the one before left; and cycles of each of them and of the prediction.
STEPS, CYCLES = 5, 3

#: Measures of a run besides those of `calibration.WEIGHTS`.
MORE = ("active_contexts", "evicted_contexts")


@dataclass(frozen=True)
class Scenario:
    """A graph with a shock; nodes (node), edges (edge_id, ts, src, dst, layer, weight)."""

    name: str
    nodes: DataFrame
    edges: DataFrame
    shock: cycles.Perturbation
    polarity: DataFrame | None = None


def scenarios(nodes: DataFrame, edges: DataFrame, shocks: list[cycles.Perturbation]) -> list[Scenario]:
    """One scenario a shock, from tables with a column `scenario` that holds the shock's name; of one whose name is not
    there the graph is empty."""
    of = lambda df, name: df.where(F.col("scenario") == name).drop("scenario")
    return [Scenario(p.name, of(nodes, p.name), of(edges, p.name), p) for p in shocks]


def probe(done: cycles.Run, s: Scenario, settings: dict, steps: int = STEPS, n_cycles: int = CYCLES) -> tuple[dict[str, float], cycles.Carry]:
    """({churn, retention, diversity}, carry): means over further runs on the scenario, the first of them from its own graph,
    each after that from the graph that the one before left."""
    edges, graph, carry, seen = s.edges, s.name, done.carry, []
    for _ in range(max(1, steps)):
        done = cycles.run(s.nodes, edges, s.shock, n_cycles, carry=carry, polarity=s.polarity, settings=settings, graph=graph)
        m = cycles.means(done.rows)
        seen.append((m["applied_new_edges"] + m["applied_drop_edges"], clip(1 - m["supervisory_forgetting_score"]), clip(m["cross_scale_consistency"])))
        edges, graph, carry = done.edges, done.graph, done.carry
    return dict(zip(("churn", "retention", "diversity"), (sum(x) / len(seen) for x in zip(*seen)))), carry


def measured(config: str, settings: dict, over: list[Scenario], steps: int = STEPS, n_cycles: int = CYCLES) -> Iterator[dict]:
    """One dict a scenario, in their order.  What a candidate learns on one scenario it has on the next."""
    carry = None
    for s in over:
        done = cycles.run(s.nodes, s.edges, s.shock, n_cycles, carry=carry, polarity=s.polarity, settings=settings, graph=s.name)
        m, critical = cycles.means(done.rows), cycles.phases(done.rows)["critical"]
        longer, carry = probe(done, s, settings, steps, n_cycles)
        yield longer | {
            "config": config, "scenario": s.name, "objective": m["adjustment_objective_score"], "critical": critical, "coupling": m["coupling_penalty"], "edits": m["applied_new_edges"] + m["applied_drop_edges"], "converged": float(done.converged),
            "confusion": m["supervisory_confusion_score"], "forgetting": m["supervisory_forgetting_score"], "active_contexts": m["cluster_active_contexts"], "evicted_contexts": m["cluster_evicted_contexts"],
        }


def runs(spark: SparkSession, settings: DataFrame, over: list[Scenario], steps: int = STEPS, n_cycles: int = CYCLES) -> DataFrame:
    """(config, scenario, a measure for each of `calibration.WEIGHTS` and MORE): one row a candidate and scenario.

    Candidates (as of `calibration.candidates`) follow each other, and a candidate's scenarios too; the graphs stay tables.
    A run's tables are deleted when its candidate is done.  No candidates or scenarios give no rows."""
    names = [*calibration.WEIGHTS, *MORE]
    rows = []
    for r in settings.orderBy("place").collect():  # settings are few
        chosen = {k: v for k, v in r.asDict().items() if k not in ("config", "place")}
        with scratch(spark):
            rows += [(m["config"], m["scenario"], *[float(m[n]) for n in names]) for m in measured(r.config, chosen, over, steps, n_cycles)]
    return spark.createDataFrame(rows, "config string, scenario string, " + ", ".join(f"{n} double" for n in names))


def scored(measures: DataFrame, settings: DataFrame) -> DataFrame:
    """One row a candidate that ran: place, the means of its measures, and its score."""
    more = measures.groupBy("config").agg(*[F.avg(c).alias(c) for c in MORE])
    return calibration.scores(measures, "config").join(more, "config").join(settings.select("config", "place"), "config")


def calibrate(spark: SparkSession, over: list[Scenario], batch: str = "default", fraction: float = 0.4, steps: int = STEPS, n_cycles: int = CYCLES) -> tuple[DataFrame, DataFrame]:
    """(candidates with their scores, summary with the recommended range of each setting), for the reports of `sinks`."""
    settings = calibration.candidates(spark, batch)
    done = saved(scored(runs(spark, settings, over, steps, n_cycles), settings))
    return done, sinks.calibration_summary(done, settings, batch, fraction)
