"""Reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def csv_report(rows: DataFrame, path: str) -> None:
    """CSV with a header; floats have six decimals."""
    rows.select(*[F.format_string("%.6f", c).alias(c) if t in ("float", "double") else F.col(c) for c, t in rows.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def json_trace(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown_report(rows: DataFrame, columns: list[str], score: str, k: int = 5) -> str:
    """The k best rows (lowest score first, one at least) as a Markdown table; the driver sees no others."""
    best = rows.orderBy(score, *columns).limit(max(1, k)).select(*columns, score).collect()
    cell = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    lines = [[*columns, score], ["---"] * (len(columns) + 1), *([cell(x) for x in r] for r in best)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


# The columns of the reports of a calibration, after rank and setting, and where each comes from.
ROW_COLUMNS = {
    "score": "score", "avg_adjustment_objective": "objective", "avg_critical_transition": "critical", "avg_coupling_penalty": "coupling", "avg_applied_edits": "edits", "avg_converged": "converged",
    "avg_supervisory_confusion": "confusion", "avg_supervisory_forgetting": "forgetting", "avg_longrun_churn": "churn", "avg_longrun_retention": "retention", "avg_longrun_diversity": "diversity",
    "avg_cluster_ann_cache_hit_rate": "hit_rate", "avg_cluster_active_contexts": "active_contexts", "avg_cluster_evicted_contexts": "evicted_contexts",
}
RANGES = {"eta_up": "eta_up", "eta_down": "eta_down", "theta_on": "theta_on", "theta_off": "theta_off", "hysteresis_dwell": "dwell", "risk_weight_base": "risk_weight", "volatility_weight_base": "volatility_weight"}
TOP = {"Score": "score", "Obj": "objective", "Critical": "critical", "Coupling": "coupling", "Churn(LR)": "churn", "Retention(LR)": "retention", "Diversity(LR)": "diversity", "ANN Hit": "hit_rate", "Ctx Active": "active_contexts", "Ctx Evicted": "evicted_contexts"}


def _ranked(scored: DataFrame) -> DataFrame:
    """The settings with their rank, from 1, by score and place; measures that are not there count as 0.  Settings are few."""
    place = "place" if "place" in scored.columns else "config"
    rows = scored.select("config", place, *[F.coalesce(F.round(F.col(c).cast("double"), 6), F.lit(0.0)).alias(c) if c in scored.columns else F.lit(0.0).alias(c) for c in ROW_COLUMNS.values()])
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("score", place)))


def calibration_rows(scored: DataFrame) -> DataFrame:
    """The rows of a calibration as text, in the order and with the names of its report: 16 columns, six decimals."""
    rows = _ranked(scored).orderBy("rank")
    return rows.select(F.col("rank").cast("string").alias("rank"), F.col("config").alias("config_id"), *[F.format_string("%.6f", c).alias(name) for name, c in ROW_COLUMNS.items()])


def calibration_summary(scored: DataFrame, candidates: DataFrame, batch: str, fraction: float = 0.4) -> DataFrame:
    """One row of 17 columns: the batch, its candidates, how many of them count as best, and the range of each setting among
    those.  No candidates give zeros."""
    ranked = _ranked(scored)
    n = ranked.count()  # settings, not runs
    best = ranked.where(F.col("rank") <= max(1, round(n * max(0.1, min(0.9, fraction))))).join(candidates.drop("place", "score"), "config")
    ends = [F.coalesce(f(c), F.lit(0)).alias(f"{name}_{end}") for name, c in RANGES.items() for end, f in (("min", F.min), ("max", F.max))]
    row = best.agg(F.count("*").alias("top_count"), *ends)
    return row.select(F.lit(batch).alias("batch"), F.lit(n).alias("candidate_count"), *row.columns)


def calibration_csv(rows: DataFrame, path: str) -> None:
    """A report of `calibration_rows` or `calibration_summary` as one CSV file with a header, in its order."""
    csv_report(rows.coalesce(1), path)


def calibration_markdown(scored: DataFrame, summary: DataFrame, k: int = 5) -> str:
    """The report of a calibration: what it was, the recommended range of each setting, and its k best candidates (one at
    least); the driver sees no others."""
    s = summary.first().asDict()
    span = lambda name, shown: f"{shown}={s[name + '_min']:.3f}..{s[name + '_max']:.3f}"
    ranges = [span(name, name) for name in ("eta_up", "eta_down", "theta_on", "theta_off")] + [f"dwell={s['hysteresis_dwell_min']}..{s['hysteresis_dwell_max']}"]
    lines = ["# Calibration Report", "", "## Summary", f"- Batch: `{s['batch']}` | Candidates: `{s['candidate_count']}` | Top Window: `{s['top_count']}`", "- Recommended Range: " + ", ".join(f"`{r}`" for r in ranges), "", "## Top Candidates"]
    lines += ["| " + " | ".join(["Rank", "Config", *TOP]) + " |", "|---:|---|" + "---:|" * len(TOP)]
    decimals = {"active_contexts": 2, "evicted_contexts": 2}
    for r in _ranked(scored).orderBy("rank").limit(max(1, k)).collect():
        lines.append("| " + " | ".join([str(r["rank"]), f"`{r['config']}`", *[f"{r[c]:.{decimals.get(c, 4)}f}" for c in TOP.values()]]) + " |")
    return "\n".join([*lines, "", "## Notes", "- Lower `Score` is better.", "- Long-run (LR) metrics summarize repeated-cycle guardrail behavior.", ""])
