"""Task execution (input: ``task_instance``; pools and SLA misses have their own tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import first_label, percent, ratio
from ..functions.scale import top_rows, top_with_percentiles
from ..functions.sketches import distinct_count, sketched
from ..functions.timeexpr import AsOf, days_before, hours_between, in_window, seconds_between, timestamp_lit

TASK = ["dag_id", "task_id"]


def by_task(*order) -> list:
    return [*order, F.asc("dag_id"), F.asc("task_id")]


def successful_durations(task_instance: DataFrame, as_of: AsOf, analysis_days: int) -> DataFrame:
    """Durations above zero of successful, ended attempts in the window."""
    return (
        task_instance.where(in_window("start_date", as_of, analysis_days) & (F.col("state") == "success"))
        .select(*TASK, "start_date", seconds_between("end_date", "start_date").alias("seconds"))
        .where(F.col("seconds") > 0)
    )


def task_duration_trends(
    task_instance: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    min_count: int = 5,
    limit: int | None = 30,
    approximate: float | None = None,
) -> DataFrame:
    """Duration statistics per task and the change from the older to the recent half of the window.

    ``approximate`` allows a rank error (a share of the rows of a key) and takes the percentiles from sketches, in one pass.
    """
    durations = successful_durations(task_instance, as_of, analysis_days)
    split = days_before(as_of, analysis_days // 2)
    recent = F.to_date("start_date") >= F.to_date(split)
    stats = (
        durations.groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("execution_count"),
            F.round(F.avg("seconds"), 2).alias("avg_duration_seconds"),
            F.round(F.stddev_samp("seconds"), 2).alias("stddev_duration_seconds"),
            F.round(F.min("seconds"), 2).alias("min_duration_seconds"),
            F.round(F.max("seconds"), 2).alias("max_duration_seconds"),
            F.avg(F.when(recent, F.col("seconds"))).alias("recent"),
            F.avg(F.when(~recent, F.col("seconds"))).alias("old"),
            *sketched("seconds", approximate),
        )
        .where((F.col("execution_count") >= min_count) & F.col("recent").isNotNull() & F.col("old").isNotNull())
        .withColumn("change", ratio(F.col("recent") - F.col("old"), "old"))
    )
    order = by_task(F.abs("change").desc())
    return (
        top_with_percentiles(stats, durations, TASK, "seconds", {"p50": 0.5, "p95": 0.95}, order, limit)
        .select(
            *TASK,
            "execution_count",
            "avg_duration_seconds",
            "stddev_duration_seconds",
            "min_duration_seconds",
            "max_duration_seconds",
            F.round("p50", 2).alias("median_duration_seconds"),
            F.round("p95", 2).alias("p95_duration_seconds"),
            F.round("recent", 2).alias("recent_avg_duration"),
            F.round("old", 2).alias("old_avg_duration"),
            F.round(F.col("change") * 100.0, 2).alias("duration_change_percent"),
        )
    )


def duration_trend_status(trends: DataFrame) -> DataFrame:
    """Label the change of ``task_duration_trends``."""
    change = F.coalesce("duration_change_percent", F.lit(0.0))
    return trends.select(
        *TASK,
        "execution_count",
        "avg_duration_seconds",
        "duration_change_percent",
        first_label(
            (change > 50, "Degrading"), (change > 20, "Slower"), (change < -20, "Improved"), otherwise="Stable"
        ).alias("status"),
    )


def task_retry_patterns(
    task_instance: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    limit: int | None = 30,
    approximate_distinct: float | None = None,
) -> DataFrame:
    """Retries per task; the retry rate is per attempt, the failure rate per run.

    ``approximate_distinct`` allows a relative error in the count of runs.
    """
    stats = (
        task_instance.where(in_window("start_date", as_of, analysis_days))
        .groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("total_attempts"),
            distinct_count("run_id", approximate_distinct).alias("unique_runs"),
            F.count_if(F.col("try_number") > 1).alias("retry_attempts"),
            F.max("try_number").alias("max_retries"),
            F.count_if(F.col("state") == "success").alias("success_count"),
            F.count_if(F.col("state") == "failed").alias("failed_count"),
        )
        .where(F.col("retry_attempts") > 0)
        .withColumn("retry_rate_percent", percent("retry_attempts", "total_attempts"))
        .withColumn("failure_rate_percent", percent("failed_count", "unique_runs"))
    )
    return top_rows(stats, by_task(F.desc("retry_attempts")), limit)


def queue_depth(task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7) -> DataFrame:
    """Queued, running and scheduled tasks per hour, summed up in one row.

    The second step sees at most one row per hour of the window.
    """
    hourly = (
        task_instance.where(in_window("start_date", as_of, analysis_days))
        .groupBy(F.date_trunc("hour", "start_date").alias("hour"))
        .agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "scheduled")])
    )
    return hourly.agg(
        F.max("queued").alias("max_queued"),
        F.avg("queued").alias("avg_queued"),
        F.percentile("queued", F.lit(0.95)).alias("p95_queued"),
        F.max("running").alias("max_running"),
        F.avg("running").alias("avg_running"),
        F.max("scheduled").alias("max_scheduled"),
        F.avg("scheduled").alias("avg_scheduled"),
        F.count(F.lit(1)).alias("sample_hours"),
    )


def executor_queue_lag(
    task_instance: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    min_count: int = 5,
    limit: int | None = 30,
    approximate: float | None = None,
) -> DataFrame:
    """Queue-to-start time of tasks that started, slowest average first.

    ``approximate`` allows a rank error (a share of the rows of a key) and takes the percentiles from sketches, in one pass.
    """
    lags = (
        task_instance.where(
            in_window("start_date", as_of, analysis_days) & F.col("state").isin("success", "failed", "running")
        )
        .select(*TASK, seconds_between("start_date", "queued_dttm").alias("lag"))
        .where(F.col("lag") >= 0)
    )
    stats = (
        lags.groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("task_count"),
            F.avg("lag").alias("mean"),
            F.round(F.min("lag"), 2).alias("min_queue_lag_seconds"),
            F.round(F.max("lag"), 2).alias("max_queue_lag_seconds"),
            *sketched("lag", approximate),
        )
        .where(F.col("task_count") >= min_count)
    )
    order = by_task(F.desc("mean"))
    return (
        top_with_percentiles(stats, lags, TASK, "lag", {"p95": 0.95}, order, limit)
        .select(
            *TASK,
            "task_count",
            F.round("mean", 2).alias("avg_queue_lag_seconds"),
            "min_queue_lag_seconds",
            "max_queue_lag_seconds",
            F.round("p95", 2).alias("p95_queue_lag_seconds"),
        )
    )


def queued_duration(
    task_instance: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    min_avg_seconds: float = 10.0,
    limit: int | None = 30,
    approximate: float | None = None,
) -> DataFrame:
    """Time in the queue of any state, by the time the task was queued.

    ``approximate`` allows a rank error (a share of the rows of a key) and takes the percentiles from sketches, in one pass.
    """
    waits = (
        task_instance.where(in_window("queued_dttm", as_of, analysis_days))
        .select(*TASK, seconds_between("start_date", "queued_dttm").alias("wait"))
        .where(F.col("wait") >= 0)
    )
    stats = (
        waits.groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("task_count"),
            F.avg("wait").alias("mean"),
            F.round(F.max("wait"), 2).alias("max_queue_seconds"),
            F.count_if(F.col("wait") > 60).alias("queued_over_1min"),
            F.count_if(F.col("wait") > 300).alias("queued_over_5min"),
            *sketched("wait", approximate),
        )
        .where(F.col("mean") > min_avg_seconds)
    )
    order = by_task(F.desc("mean"))
    return (
        top_with_percentiles(stats, waits, TASK, "wait", {"p50": 0.5, "p95": 0.95}, order, limit)
        .select(
            *TASK,
            "task_count",
            F.round("mean", 2).alias("avg_queue_seconds"),
            F.round("p50", 2).alias("median_queue_seconds"),
            F.round("p95", 2).alias("p95_queue_seconds"),
            "max_queue_seconds",
            "queued_over_1min",
            "queued_over_5min",
        )
    )


def pool_utilisation(
    task_instance: DataFrame, slot_pool: DataFrame, *, as_of: AsOf, analysis_days: int = 7
) -> DataFrame:
    """Hourly pool load against the pool's slots; the join sees one row per pool."""
    hourly = (
        task_instance.where(in_window("start_date", as_of, analysis_days) & (F.col("pool") != "default_pool"))
        .groupBy("pool", F.date_trunc("hour", "start_date").alias("hour"))
        .agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("state") == "running").alias("running"))
    )
    per_pool = hourly.groupBy("pool").agg(
        F.count(F.lit(1)).alias("active_hours"),
        F.avg("tasks").alias("tasks_mean"),
        F.max("tasks").alias("max_tasks"),
        F.avg("running").alias("running_mean"),
        F.max("running").alias("max_running"),
    )
    slots = slot_pool.select("pool", F.col("slots").alias("pool_slots"))
    return (
        per_pool.join(slots, "pool", "left")
        .select(
            "pool",
            "pool_slots",
            "active_hours",
            F.round("tasks_mean", 2).alias("avg_tasks"),
            "max_tasks",
            F.round("running_mean", 2).alias("avg_running"),
            "max_running",
            percent("running_mean", "pool_slots").alias("avg_utilization_percent"),
            percent("max_running", "pool_slots").alias("peak_utilization_percent"),
        )
        .orderBy(F.desc_nulls_first("avg_utilization_percent"), "pool")
    )


def pool_utilisation_status(utilisation: DataFrame) -> DataFrame:
    """Over- and underused pools."""
    peak = F.coalesce("peak_utilization_percent", F.lit(0.0))
    average = F.coalesce("avg_utilization_percent", F.lit(0.0))
    return utilisation.select(
        "pool",
        "avg_utilization_percent",
        "peak_utilization_percent",
        first_label((peak > 90, "Overutilized"), (average < 20, "Underutilized"), otherwise="Normal").alias("status"),
    )


def zombie_tasks(
    task_instance: DataFrame, *, as_of: AsOf, min_hours: int = 6, limit: int | None = 50
) -> DataFrame:
    """Tasks still running after ``min_hours``, oldest first."""
    now = timestamp_lit(as_of)
    stuck = task_instance.where(
        (F.col("state") == "running") & (F.col("start_date") < now - F.expr(f"INTERVAL {int(min_hours)} HOURS"))
    ).select(
        *TASK,
        "run_id",
        "state",
        "start_date",
        hours_between(now, "start_date").alias("hours_running"),
        "hostname",
        "pid",
    )
    order = [F.asc(c) for c in ("start_date", "dag_id", "task_id", "run_id", "hostname", "pid")]
    return top_rows(stuck, order, limit)


def execution_variance(
    task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7, min_count: int = 5, limit: int | None = 30
) -> DataFrame:
    """Spread of task durations, highest coefficient of variation first."""
    seconds = F.col("seconds")
    stats = (
        successful_durations(task_instance, as_of, analysis_days)
        .groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("execution_count"),
            F.avg(seconds).alias("mean"),
            F.stddev_samp(seconds).alias("sd"),
            F.min(seconds).alias("low"),
            F.max(seconds).alias("high"),
        )
        .where((F.col("execution_count") >= min_count) & F.col("sd").isNotNull())
    )
    return top_rows(stats, by_task(ratio("sd", "mean").desc()), limit).select(
        *TASK,
        "execution_count",
        F.round("mean", 2).alias("avg_duration_seconds"),
        F.round("sd", 2).alias("stddev_duration_seconds"),
        F.round("low", 2).alias("min_duration_seconds"),
        F.round("high", 2).alias("max_duration_seconds"),
        percent("sd", "mean").alias("coefficient_of_variation"),
        F.round(ratio(F.col("high") - F.col("low"), "mean"), 2).alias("range_ratio"),
    )


def sla_miss_patterns(
    sla_miss: DataFrame, *, as_of: AsOf, analysis_days: int = 7, limit: int | None = 30
) -> DataFrame:
    """Missed deadlines per task and their mean delay."""
    stats = (
        sla_miss.where(in_window("timestamp", as_of, analysis_days))
        .groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("sla_miss_count"),
            F.max("timestamp").alias("last_sla_miss"),
            F.min("timestamp").alias("first_sla_miss"),
            F.countDistinct(F.to_date("timestamp")).alias("days_with_misses"),
            F.avg(seconds_between("timestamp", "execution_date")).alias("avg_delay_seconds"),
        )
    )
    return top_rows(stats, by_task(F.desc("sla_miss_count")), limit)
