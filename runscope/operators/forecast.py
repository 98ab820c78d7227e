"""Failure prediction, capacity forecast, degradation, anomalies, seasons and table growth."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import first_label, percent, ratio
from ..functions.scale import salted_join, top_rows
from ..functions.timeexpr import AsOf, day_name, day_of_week, days_before, hour_of_day, in_window, seconds_between
from .tasks import TASK, by_task, successful_durations


def failure_prediction(
    task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7, limit: int | None = 30
) -> DataFrame:
    """Failure rate per task and whether failures move to the recent half of the window."""
    failed = F.col("state") == "failed"
    recent_day = F.to_date("start_date") >= F.to_date(days_before(as_of, analysis_days // 2))
    recent, old, rate = F.col("recent_failures"), F.col("old_failures"), F.col("failure_rate")
    stats = (
        task_instance.where(in_window("start_date", as_of, analysis_days) & F.col("state").isin("success", "failed"))
        .groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(failed).alias("failure_count"),
            F.count_if(failed & recent_day).alias("recent_failures"),
            F.count_if(failed & ~recent_day).alias("old_failures"),
        )
        .where(F.col("failure_count") > 0)
        .withColumn("failure_rate", percent("failure_count", "total_runs"))
    )
    order = by_task(F.when(recent > old, 1).otherwise(2), F.desc("failure_rate"))
    return top_rows(stats, order, limit).select(
        *TASK,
        "total_runs",
        "failure_count",
        "failure_rate",
        "recent_failures",
        "old_failures",
        first_label(
            ((recent > old) & (rate > 10), "Increasing"),
            ((recent < old) & (rate > 5), "Decreasing"),
            (rate > 20, "High"),
            (rate > 10, "Moderate"),
            otherwise="Low",
        ).alias("failure_trend"),
        F.round((ratio("recent_failures", "old_failures") - 1.0) * 100.0, 2).alias("trend_change_percent"),
    )


def failure_risk_level(prediction: DataFrame) -> DataFrame:
    """Risk label for the rows of ``failure_prediction``."""
    rate, increasing = F.col("failure_rate"), F.col("failure_trend") == "Increasing"
    return prediction.select(
        *TASK,
        "failure_rate",
        "failure_trend",
        first_label(
            (increasing & (rate > 20), "Critical"),
            (increasing, "High"),
            (rate > 30, "High"),
            (rate > 15, "Medium"),
            otherwise="Low",
        ).alias("risk_level"),
    )


def capacity_forecast(task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7) -> DataFrame:
    """Mean daily load and its linear growth per day (one row)."""
    daily = (
        task_instance.where(in_window("start_date", as_of, analysis_days) & F.col("end_date").isNotNull())
        .groupBy(F.to_date("start_date").alias("day"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("tasks"),
            F.countDistinct("dag_id").cast("double").alias("dags"),
            F.avg(seconds_between("end_date", "start_date")).alias("seconds"),
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


def days_to_capacity(forecast: DataFrame, *, parallelism: int = 32) -> DataFrame:
    """Days until 80 % of ``parallelism`` x 24 tasks a day, from ``capacity_forecast``."""
    growth, load = F.col("tasks_growth_per_day"), F.col("current_avg_daily_tasks")
    capacity = F.lit(parallelism * 0.8 * 24)
    days = F.when((growth > 0) & (load < capacity), (capacity - load) / growth)
    return forecast.select(
        "current_avg_daily_tasks",
        "tasks_growth_per_day",
        F.round(days, 2).alias("days_to_80_percent"),
        first_label(
            (days < 30, "Critical"), (days < 90, "Warning"), (growth < -10, "Decreasing"), otherwise="Stable"
        ).alias("label"),
    )


def performance_degradation(
    task_instance: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    min_per_week: int = 3,
    min_weeks: int = 3,
    limit: int | None = 30,
) -> DataFrame:
    """Tasks whose weekly mean duration rises along a line (needs three weeks or more of data)."""
    weekly = (
        successful_durations(task_instance, as_of, analysis_days)
        .groupBy(*TASK, F.date_trunc("week", "start_date").alias("week"))
        .agg(F.avg("seconds").alias("y"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_per_week)
        .withColumn("x", F.unix_seconds("week") / F.lit(604_800.0))
    )
    slope, fit = F.col("slope"), F.col("fit")
    trends = (
        weekly.groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("weeks"),
            F.avg("y").alias("mean"),
            F.regr_slope("y", "x").alias("slope"),
            F.regr_r2("y", "x").alias("fit"),
        )
        .where((F.col("weeks") >= min_weeks) & (slope > 0) & (fit > 0.3))
    )
    return top_rows(trends, by_task(F.desc("slope")), limit).select(
        *TASK,
        F.round("mean", 2).alias("avg_duration_seconds"),
        F.round("slope", 4).alias("duration_increase_per_week"),
        F.round("fit", 4).alias("trend_confidence"),
        first_label(
            ((slope > 0) & (fit > 0.5), "Degrading"), ((slope < 0) & (fit > 0.5), "Improving"), otherwise="Stable"
        ).alias("performance_trend"),
    )


def anomaly_detection(
    task_instance: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    min_count: int = 10,
    z_limit: float = 3.0,
    limit: int | None = 30,
) -> DataFrame:
    """Durations more than ``z_limit`` standard deviations from their task's mean.

    Durations are first counted per (task, value), then meet the statistics of just those tasks whose smallest or
    largest value is out of bounds. (Joining the rows themselves was tried: adaptive execution starts their shuffle before
    it knows that the suspect tasks are few, and rows cost more than counts.)
    """
    durations = successful_durations(task_instance, as_of, analysis_days)
    mean, sd, seconds = F.col("mean"), F.col("sd"), F.col("seconds")

    def z(value: Column) -> Column:
        return F.abs(value - mean) / F.nullif(sd, F.lit(0.0))

    bounds = (
        durations.groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(seconds).alias("mean"),
            F.stddev_samp(seconds).alias("sd"),
            F.min(seconds).alias("low"),
            F.max(seconds).alias("high"),
        )
        .where((F.col("n") >= min_count) & ((z(F.col("low")) > z_limit) | (z(F.col("high")) > z_limit)))
        .select(*TASK, "mean", "sd")
    )
    values = durations.groupBy(*TASK, "seconds").agg(
        F.count(F.lit(1)).alias("times"), F.max("start_date").alias("last")
    )
    outliers = (
        salted_join(values, bounds, TASK, ["seconds"]).withColumn("z", z(seconds)).where(F.col("z") > z_limit)
    )
    times = F.col("times")
    stats = outliers.groupBy(*TASK).agg(
        F.sum(times).alias("anomaly_count"),
        F.max("last").alias("last_anomaly"),
        F.round(F.sum(F.col("z") * times) / F.sum(times), 2).alias("avg_z_score"),
        F.round(F.max("z"), 2).alias("max_z_score"),
        F.round(F.sum(seconds * times) / F.sum(times), 2).alias("avg_anomaly_duration"),
        F.round(F.max("mean"), 2).alias("normal_duration"),
    )
    return top_rows(stats, by_task(F.desc("anomaly_count")), limit)


def seasonal_patterns(task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7) -> DataFrame:
    """Spread of hourly task counts per weekday."""
    cells = (
        task_instance.where(
            in_window("start_date", as_of, analysis_days) & F.col("end_date").isNotNull() & (F.col("state") == "success")
        )
        .groupBy(day_of_week("start_date").alias("day_of_week"), hour_of_day("start_date").alias("hour_of_day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    days = cells.groupBy("day_of_week").agg(
        F.avg("n").alias("mean"),
        F.stddev_samp("n").alias("sd"),
        F.max("n").alias("max_executions"),
        F.min("n").alias("min_executions"),
    )
    return days.select(
        "day_of_week",
        day_name("day_of_week").alias("day_name"),
        F.round("mean", 2).alias("avg_executions_per_hour"),
        F.round("sd", 2).alias("stddev_executions"),
        "max_executions",
        "min_executions",
        percent("sd", "mean").alias("coefficient_of_variation"),
    ).orderBy("day_of_week")


# fixed values: tables whose rows carry a state, then those without
STATE_TABLES = ["task_instance", "dag_run"]
PLAIN_TABLES = ["log", "job", "xcom"]

# fixed values: the time column that growth is measured on
GROWTH_COLUMNS = {"task_instance": "execution_date", "dag_run": "execution_date", "log": "dttm"}


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, by state where the table has one."""
    parts = []
    for name in [*STATE_TABLES, *PLAIN_TABLES]:
        if name not in tables:
            continue
        states = {"running_count": "running", "queued_count": "queued", "failed_count": "failed"}
        by_state = [
            (F.count_if(F.col("state") == s) if name in STATE_TABLES else F.lit(None).cast("long")).alias(c)
            for c, s in states.items()
        ]
        parts.append(
            tables[name].agg(F.count(F.lit(1)).alias("row_count"), *by_state).select(F.lit(name).alias("table_name"), "*")
        )
    return _stacked(parts)


def table_size_status(counts: DataFrame) -> DataFrame:
    """Row-count alarms for the tables that are known to grow."""
    name, rows = F.col("table_name"), F.col("row_count")
    return counts.select(
        "table_name",
        "row_count",
        first_label(
            ((name == "task_instance") & (rows > 10_000_000), "Critical"),
            ((name == "task_instance") & (rows > 5_000_000), "Warning"),
            (name.isin("log", "xcom") & (rows > 1_000_000), "Warning"),
            otherwise="Normal",
        ).alias("status"),
    )


def table_growth(tables: Mapping[str, DataFrame], *, as_of: AsOf, analysis_days: int = 7) -> DataFrame:
    """Rows inside the window, rows per day and their share of each table."""
    parts = []
    for name, ts in GROWTH_COLUMNS.items():
        if name not in tables:
            continue
        parts.append(
            tables[name]
            .agg(
                F.count(F.lit(1)).alias("current_rows"),
                F.count_if(in_window(ts, as_of, analysis_days)).alias("recent_rows"),
            )
            .select(F.lit(name).alias("table_name"), "*")
        )
    return _stacked(parts).select(
        "*",
        F.round(ratio("recent_rows", F.lit(analysis_days)), 2).alias("rows_per_day"),
        percent("recent_rows", "current_rows").alias("recent_percentage"),
    )


def days_to_row_limit(
    growth: DataFrame, *, row_limit: int = 10_000_000, min_rows_per_day: float = 10_000, alert_days: float = 30
) -> DataFrame:
    """Days until fast-growing tables reach ``row_limit``."""
    per_day = F.col("rows_per_day")
    days = F.when(per_day > min_rows_per_day, ratio(F.lit(row_limit) - F.col("current_rows"), per_day))
    return growth.select(
        "table_name",
        "current_rows",
        "rows_per_day",
        F.round(days, 2).alias("days_to_limit"),
        F.coalesce(days < alert_days, F.lit(False)).alias("is_alert"),
    )


def _stacked(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("none of the known tables was given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
