"""Run, step, action and alert logs as append-only tables."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosa.functions.columns import percent
from prosa.operators.ordering import latest_per_key
from prosa.schemas import NOTEBOOK_RUNS, STEPS_JSON


def duration_sec(start: str = "started_at", end: str = "completed_at") -> Column:
    """Seconds with fraction; null while open."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def current(log: DataFrame, key: str, newest_first: Sequence[Column]) -> DataFrame:
    """State of an append-only log: the latest record of every id (an upsert by reading)."""
    return latest_per_key(log, [key], newest_first)


def steps_of(runs: DataFrame, versions: DataFrame, newest_first: Sequence[Column]) -> DataFrame:
    """Current steps of these runs. A step never changes its run, so only the runs' versions are compared."""
    wanted = versions.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    return current(wanted.select(*versions.columns), "step_id", newest_first)


def latest_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)


def runs_with_steps(runs: DataFrame, steps: DataFrame, limit: int = 10) -> DataFrame:
    """The latest runs, newest first, with their steps in time order: one row per step, one row
    with null step columns for a run without steps. Steps are not collected into arrays, so a run
    may have any number of them."""
    newest = latest_runs(runs, limit).withColumn("run_duration_sec", duration_sec())
    chosen = newest.select(
        "run_id", F.col("status").alias("run_status"), F.col("started_at").alias("run_started_at"),
        "run_duration_sec", "layers", "trigger")
    detail = steps.select(
        "run_id", "step_id", "step_name", F.col("status").alias("step_status"), "rows_output",
        F.col("started_at").alias("step_started_at"), duration_sec().alias("step_duration_sec"),
        "error_message")
    return chosen.join(detail, "run_id", "left").orderBy(
        F.desc("run_started_at"), "run_id", F.asc_nulls_first("step_started_at"), "step_id")


def steps_from_json(runs: DataFrame, column: str = "steps_json") -> DataFrame:
    """Steps of runs that carry them as JSON text."""
    parsed = runs.select("run_id", F.explode(F.from_json(column, STEPS_JSON)).alias("s"))
    return parsed.select("run_id", *[F.col(f"s.{f.name}").alias(f.name)
                                     for f in STEPS_JSON.elementType.fields if f.name != "run_id"])


def recent_actions(actions: DataFrame, limit: int = 50, agent: str | None = None) -> DataFrame:
    if agent is not None:
        actions = actions.where(F.col("agent_name") == agent)
    return actions.orderBy(F.desc("timestamp"), "action_id").limit(limit)


def recent_alerts(alerts: DataFrame, limit: int = 20, unresolved_only: bool = False) -> DataFrame:
    if unresolved_only:
        alerts = alerts.where(~F.col("resolved"))
    return alerts.orderBy(F.desc("timestamp"), "alert_id").limit(limit)


def durations(log: DataFrame, key: str) -> DataFrame:
    return log.select(key, "status", duration_sec().alias("duration_sec"))


def run_summary(runs: DataFrame, steps: DataFrame,
                status: Sequence[str] | None = None, trigger: Sequence[str] | None = None) -> DataFrame:
    """Per run: completed and total steps, rows, first error, duration. Steps are reduced per run
    before the join, so both sides have one row per run."""
    if status is not None:
        runs = runs.where(F.col("status").isin(*status))
    if trigger is not None:
        runs = runs.where(F.col("trigger").isin(*trigger))
    order = F.struct("started_at", "step_id")
    failed = F.col("error_message").isNotNull() & (F.col("error_message") != "")
    per_run = steps.groupBy("run_id").agg(
        F.count_if(F.col("status") == "completed").alias("steps_ok"),
        F.count(F.lit(1)).alias("steps_total"),
        F.sum(F.coalesce("rows_output", F.lit(0))).alias("total_rows"),
        F.min_by("error_message", F.when(failed, order)).alias("first_error"),
    )
    zero = F.lit(0).cast("long")
    return runs.join(per_run, "run_id", "left").select(
        "run_id", "status", "trigger", "layers",
        F.coalesce("steps_ok", zero).alias("steps_ok"),
        F.coalesce("steps_total", zero).alias("steps_total"),
        F.coalesce("total_rows", zero).alias("total_rows"),
        "first_error", duration_sec().alias("duration_sec"),
    )


def run_counts(runs: DataFrame) -> DataFrame:
    """Runs per status and trigger."""
    return runs.groupBy("status", "trigger").agg(F.count(F.lit(1)).alias("runs"))


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == "completed").alias("runs_completas"),
        F.count_if(F.col("status") == "failed").alias("runs_com_falha"),
    )


def step_results(spark: SparkSession, results: Sequence[tuple]) -> DataFrame:
    """Results of the steps of one run as a table: notebook, status, duration_sec, rows_written,
    error, timestamp."""
    return spark.createDataFrame(list(results), NOTEBOOK_RUNS)


def step_result_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("notebooks"),
        F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("duracao_total_sec"),
        F.coalesce(F.sum("rows_written"), F.lit(0)).alias("total_rows"),
        F.count_if(F.col("status") != "sucesso").alias("falhas"),
    )


def agent_metrics(actions: DataFrame) -> DataFrame:
    """Per agent: actions, success, tokens, cost and the models used. The set of models is bounded
    by the price list and combined before the shuffle."""
    used = F.nullif("model_used", F.lit(""))
    return actions.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("total_acoes"),
        F.count_if("success").alias("acoes_sucesso"),
        F.count_if(~F.col("success")).alias("acoes_falha"),
        F.sum("cost").alias("custo"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.array_join(F.array_sort(F.collect_set(used)), ", ").alias("modelos"),
    ).withColumn("taxa_sucesso_pct", percent("acoes_sucesso", "total_acoes", 0))
