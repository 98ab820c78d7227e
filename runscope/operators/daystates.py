"""Partial states per day, kept as a table, from which rolling windows are computed without reading old rows again.

A state row holds what can be merged: counts, sums, extremes, squared deviations and quantile sketches. ``add_day`` reads one
day of a source table and replaces that day's states; the ``*_from_states`` functions give the rows of the operators of the
same name for any window that ends at midnight. Distinct days and workflows are counted exactly, since days and workflows
are keys of the states; percentiles come from sketches.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import first_label, ratio
from ..functions.scale import top_rows
from ..functions.sketches import SKETCH, merged_quantiles, quantile_of, quantile_sketch
from ..functions.timeexpr import day_of_week, hours_between, in_window, seconds_between
from .tasks import TASK, by_task

#: Rank error of the sketches that are stored.
STORED_ERROR = 0.005


def _moments(value: str, name: str) -> list[Column]:
    """Aggregates: count, sum and squared deviations from the mean."""
    return [
        F.count(value).alias(f"{name}_n"),
        F.sum(value).alias(f"{name}_sum"),
        (F.var_pop(value) * F.count(value)).alias(f"{name}_m2"),
    ]


def _mean(name: str) -> Column:
    return F.sum(f"{name}_sum") / F.sum(f"{name}_n")


def _stddev(name: str) -> Column:
    """Sample standard deviation over states: deviations inside them, and of their means from the mean of all."""
    n, total = F.sum(f"{name}_n"), F.sum(f"{name}_sum")
    squares = F.sum(F.try_divide(F.col(f"{name}_sum") * F.col(f"{name}_sum"), F.col(f"{name}_n")))
    inside = F.sum(f"{name}_m2") + squares - total * total / n
    return F.when(n > 1, F.sqrt(F.greatest(inside, F.lit(0.0)) / (n - 1)))


def run_states(dag_run: DataFrame) -> DataFrame:
    """A row for each (day, hour, dag_id) of the schedule time."""
    state, seconds = F.col("state"), seconds_between("end_date", "start_date")
    rows = dag_run.where(F.col("execution_date").isNotNull()).select("dag_id", "state", "execution_date", seconds.alias("seconds"))
    keys = [F.to_date("execution_date").alias("day"), F.hour("execution_date").alias("hour"), "dag_id"]
    finished = F.when(F.col("seconds").isNotNull(), F.col("execution_date"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.count_if(state == s).alias(s) for s in ("success", "failed", "running", "queued")],
        *_moments("seconds", "seconds"),
        F.min("seconds").alias("seconds_min"),
        F.max("seconds").alias("seconds_max"),
        F.min(finished).alias("first_finished"),
        F.max(finished).alias("last_finished"),
    )


def task_states(task_instance: DataFrame, *, error: float = STORED_ERROR) -> DataFrame:
    """A row for each (day, dag_id, task_id) of the start: successful durations above zero, and ended attempts of any state."""
    seconds = seconds_between("end_date", "start_date")
    rows = task_instance.where(F.col("start_date").isNotNull()).select(*TASK, "state", "start_date", seconds.alias("any_seconds"))
    rows = rows.withColumn("seconds", F.expr("CASE WHEN state = 'success' AND any_seconds > 0 THEN any_seconds END"))
    return rows.groupBy(F.to_date("start_date").alias("day"), *TASK).agg(
        *_moments("seconds", "seconds"),
        F.min("seconds").alias("seconds_min"),
        F.max("seconds").alias("seconds_max"),
        quantile_sketch("seconds", error).alias(SKETCH),
        F.count("any_seconds").alias("ended"),
        F.sum("any_seconds").alias("ended_seconds"),
    )


#: The time column that decides to which day a row belongs.
DAY_OF = {run_states: "execution_date", task_states: "start_date"}


def add_day(source: DataFrame, states: Callable[[DataFrame], DataFrame], day: date, path: str) -> DataFrame:
    """Computes the states of one day and puts them in place of that day's, whatever was there; returns what was read.

    The day's bounds are bare comparisons, so they reach the scan. Only the day's folder is written: a run that fails or is
    repeated leaves the other days as they are, and the day as after one run.
    """
    rows = source.where(in_window(DAY_OF[states], (day + timedelta(days=1)).isoformat(), 1))
    made = states(rows)
    made.drop("day").write.mode("overwrite").parquet(f"{path}/day={day.isoformat()}")
    return rows


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))


def _window(states: DataFrame, as_of: date, analysis_days: int) -> DataFrame:
    """States of the days before ``as_of`` (which begins at midnight)."""
    first = as_of - timedelta(days=analysis_days)
    return states.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(as_of)))


def run_performance_from_states(states: DataFrame, *, as_of: date, analysis_days: int = 7) -> DataFrame:
    """The rows of ``runs.run_performance``."""
    total, won = F.sum("runs"), F.sum("success")
    return (
        _window(states, as_of, analysis_days)
        .groupBy("dag_id")
        .agg(
            total.alias("total_runs"),
            won.alias("successful_runs"),
            F.sum("failed").alias("failed_runs"),
            F.sum("running").alias("running_runs"),
            F.sum("queued").alias("queued_runs"),
            F.round(won * 100.0 / total, 2).alias("success_rate_percent"),
            F.try_divide(F.sum("seconds_sum"), F.sum("seconds_n")).alias("avg_runtime_seconds"),
            F.max("seconds_max").alias("max_runtime_seconds"),
            F.min("seconds_min").alias("min_runtime_seconds"),
            F.countDistinct("day").alias("active_days"),
        )
        .orderBy(F.desc("total_runs"), "dag_id")
    )


def hourly_traffic_from_states(states: DataFrame, *, as_of: date, analysis_days: int = 7) -> DataFrame:
    """The rows of ``runs.hourly_traffic``."""
    cells = (
        _window(states, as_of, analysis_days)
        .groupBy(F.col("hour").alias("hour_of_day"), day_of_week("day").alias("day_of_week"))
        .agg(
            F.sum("runs").alias("dag_runs"),
            F.countDistinct("dag_id").alias("unique_dags"),
            F.try_divide(F.sum("seconds_sum"), F.sum("seconds_n")).alias("avg_seconds"),
        )
    )
    return (
        cells.groupBy("hour_of_day")
        .agg(
            F.sum("dag_runs").alias("total_runs"),
            F.avg("dag_runs").alias("avg_runs_per_day"),
            F.max("dag_runs").alias("max_runs_in_hour"),
            F.avg("unique_dags").alias("avg_unique_dags"),
            F.avg("avg_seconds").alias("avg_duration_seconds"),
        )
        .orderBy("hour_of_day")
    )


def dag_frequency_from_states(states: DataFrame, *, as_of: date, analysis_days: int = 7) -> DataFrame:
    """The rows of ``runs.dag_frequency``."""
    stats = (
        _window(states, as_of, analysis_days)
        .where(F.col("seconds_n") > 0)
        .groupBy("dag_id")
        .agg(
            F.sum("seconds_n").alias("total_runs"),
            F.countDistinct("day").alias("active_days"),
            F.min("first_finished").alias("first_run"),
            F.max("last_finished").alias("last_run"),
            _mean("seconds").alias("mean"),
            _stddev("seconds").alias("sd"),
        )
    )
    wide, medium = F.col("sd") > F.col("mean") * 0.5, F.col("sd") > F.col("mean") * 0.3
    return (
        stats.where(F.col("total_runs") > 1)
        .select(
            "dag_id",
            "total_runs",
            "active_days",
            F.round(ratio("total_runs", "active_days"), 2).alias("avg_runs_per_day"),
            F.round("mean", 2).alias("avg_duration_seconds"),
            F.round("sd", 2).alias("stddev_duration_seconds"),
            first_label((wide, "High Variance"), (medium, "Medium Variance"), otherwise="Low Variance").alias("duration_variance"),
            hours_between("last_run", "first_run").alias("time_span_hours"),
        )
        .orderBy(F.desc("total_runs"), "dag_id")
    )


def task_duration_trends_from_states(
    states: DataFrame, *, as_of: date, analysis_days: int = 7, min_count: int = 5, limit: int | None = 30
) -> DataFrame:
    """The rows of ``tasks.task_duration_trends``, its percentiles within the rank error of the sketches."""
    recent = F.col("day") >= F.lit(as_of - timedelta(days=analysis_days // 2))

    def mean_of(part: Column) -> Column:
        return F.try_divide(F.sum(F.when(part, F.col("seconds_sum"))), F.sum(F.when(part, F.col("seconds_n"))))

    stats = (
        _window(states, as_of, analysis_days)
        .where(F.col("seconds_n") > 0)
        .groupBy(*TASK)
        .agg(
            F.sum("seconds_n").alias("execution_count"),
            F.round(_mean("seconds"), 2).alias("avg_duration_seconds"),
            F.round(_stddev("seconds"), 2).alias("stddev_duration_seconds"),
            F.round(F.min("seconds_min"), 2).alias("min_duration_seconds"),
            F.round(F.max("seconds_max"), 2).alias("max_duration_seconds"),
            mean_of(recent).alias("recent"),
            mean_of(~recent).alias("old"),
            merged_quantiles(SKETCH).alias(SKETCH),
        )
        .where((F.col("execution_count") >= min_count) & F.col("recent").isNotNull() & F.col("old").isNotNull())
        .withColumn("change", ratio(F.col("recent") - F.col("old"), "old"))
    )
    return top_rows(stats, by_task(F.abs("change").desc()), limit).select(
        *TASK,
        "execution_count",
        "avg_duration_seconds",
        "stddev_duration_seconds",
        "min_duration_seconds",
        "max_duration_seconds",
        F.round(quantile_of(SKETCH, 0.5), 2).alias("median_duration_seconds"),
        F.round(quantile_of(SKETCH, 0.95), 2).alias("p95_duration_seconds"),
        F.round("recent", 2).alias("recent_avg_duration"),
        F.round("old", 2).alias("old_avg_duration"),
        F.round(F.col("change") * 100.0, 2).alias("duration_change_percent"),
    )


def capacity_forecast_from_states(states: DataFrame, *, as_of: date, analysis_days: int = 7) -> DataFrame:
    """The row of ``forecast.capacity_forecast``."""
    daily = (
        _window(states, as_of, analysis_days)
        .where(F.col("ended") > 0)
        .groupBy("day")
        .agg(
            F.sum("ended").cast("double").alias("tasks"),
            F.countDistinct("dag_id").cast("double").alias("dags"),
            (F.sum("ended_seconds") / F.sum("ended")).alias("seconds"),
        )
        .withColumn("x", F.unix_date("day").cast("double"))
    )
    return daily.agg(
        F.round(F.avg("tasks"), 2).alias("current_avg_daily_tasks"),
        F.round(F.regr_slope("tasks", "x"), 4).alias("tasks_growth_per_day"),
        F.round(F.avg("dags"), 2).alias("current_avg_daily_dags"),
        F.round(F.regr_slope("dags", "x"), 4).alias("dags_growth_per_day"),
        F.round(F.avg("seconds"), 2).alias("avg_task_duration_seconds"),
    )
