"""Run health, frequency and traffic (input: ``dag_run``; task concurrency reads ``task_instance``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import first_label, labels_that_hold, percent, ratio
from ..functions.scale import exact_percentiles, interval_load, top_rows, top_with_percentiles
from ..functions.sketches import distinct_count, quantile_of, sketched
from ..functions.timeexpr import (
    AsOf,
    day_of_week,
    days_before,
    duration_label,
    hour_of_day,
    hours_between,
    in_window,
    seconds_between,
    timestamp_lit,
)


def _runtime() -> Column:
    return seconds_between("end_date", "start_date")


def run_performance(dag_run: DataFrame, *, as_of: AsOf, analysis_days: int = 7) -> DataFrame:
    """Run counts by state, success rate, run times and active days per workflow."""
    runtime = _runtime()
    state = F.col("state")
    return (
        dag_run.where(in_window("execution_date", as_of, analysis_days))
        .groupBy("dag_id")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(state == "success").alias("successful_runs"),
            F.count_if(state == "failed").alias("failed_runs"),
            F.count_if(state == "running").alias("running_runs"),
            F.count_if(state == "queued").alias("queued_runs"),
            F.round(F.count_if(state == "success") * 100.0 / F.count(F.lit(1)), 2).alias("success_rate_percent"),
            F.avg(runtime).alias("avg_runtime_seconds"),
            F.max(runtime).alias("max_runtime_seconds"),
            F.min(runtime).alias("min_runtime_seconds"),
            F.countDistinct(F.to_date("execution_date")).alias("active_days"),
        )
        .orderBy(F.desc("total_runs"), "dag_id")
    )


def run_health_status(
    performance: DataFrame,
    *,
    min_success_rate: float = 95.0,
    warn_success_rate: float = 98.0,
    long_runtime_seconds: float = 3600.0,
    top_n: int | None = 20,
) -> DataFrame:
    """Status and issue list for the busiest workflows of ``run_performance``."""
    rate = F.coalesce("success_rate_percent", F.lit(0.0))
    runtime = F.coalesce("avg_runtime_seconds", F.lit(0.0))
    low, long = rate < min_success_rate, runtime > long_runtime_seconds
    return top_rows(performance, [F.desc("total_runs"), F.asc("dag_id")], top_n).select(
        "dag_id",
        "total_runs",
        "success_rate_percent",
        "avg_runtime_seconds",
        duration_label(runtime).alias("avg_runtime"),
        first_label((low, "Critical"), (rate < warn_success_rate, "Warning"), (long, "Warning"), otherwise="Healthy").alias(
            "status"
        ),
        labels_that_hold((low, "LOW_SUCCESS_RATE"), (long, "LONG_RUNTIME")).alias("issues"),
    )


# fixed values: success-rate bucket labels
SUCCESS_BUCKETS = ["<50%", "50-80%", "80-95%", "95-100%"]


def success_rate_histogram(performance: DataFrame) -> DataFrame:
    """Workflows per success-rate bucket, empty buckets included."""
    rate = F.col("success_rate_percent")
    bucket = first_label(
        (rate < 50, SUCCESS_BUCKETS[0]), (rate < 80, SUCCESS_BUCKETS[1]), (rate < 95, SUCCESS_BUCKETS[2]),
        otherwise=SUCCESS_BUCKETS[3],
    )
    return counts_per_bucket(performance.where(rate.isNotNull()).select(bucket.alias("bucket")), SUCCESS_BUCKETS, "dags")


def counts_per_bucket(bucketed: DataFrame, buckets: list[str], count_name: str) -> DataFrame:
    """One row per label of ``buckets`` in their order, zero where no row fell in."""
    counts = bucketed.groupBy().agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in buckets])
    entries = [F.struct(F.lit(i).alias("bucket_no"), F.lit(b).alias("bucket"), F.col(f"`{b}`").alias(count_name)) for i, b in enumerate(buckets)]
    return counts.select(F.inline(F.array(*entries)))


def average_success_rate(performance: DataFrame) -> DataFrame:
    """Active workflows and the plain mean of their success rates."""
    return performance.agg(
        F.count(F.lit(1)).alias("active_dags"),
        F.coalesce(F.avg("success_rate_percent"), F.lit(0.0)).alias("avg_success_rate"),
    )


def hourly_traffic(
    dag_run: DataFrame, *, as_of: AsOf, analysis_days: int = 7, approximate_distinct: float | None = None
) -> DataFrame:
    """Traffic per hour of day; the means run over the (hour, weekday) cells that have runs.

    ``approximate_distinct`` allows a relative error in the count of workflows of a cell.
    """
    cells = (
        dag_run.where(in_window("execution_date", as_of, analysis_days))
        .groupBy(hour_of_day("execution_date").alias("hour_of_day"), day_of_week("execution_date").alias("day_of_week"))
        .agg(
            F.count(F.lit(1)).alias("dag_runs"),
            distinct_count("dag_id", approximate_distinct).alias("unique_dags"),
            F.avg(_runtime()).alias("avg_seconds"),
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


def peak_and_quiet_hours(hourly: DataFrame, *, quiet_share: float = 0.1, mode: str = "running") -> DataFrame:
    """Flag the peak hour and the quiet hours of ``hourly_traffic`` (at most 24 rows).

    ``mode="running"`` compares an hour with the peak among the hours up to it; ``mode="global"`` with the day's peak.
    """
    if mode not in ("running", "global"):
        raise ValueError(f"mode must be 'running' or 'global', not {mode!r}")
    hours = Window.orderBy("hour_of_day")
    frame = (Window.unboundedPreceding, 0 if mode == "running" else Window.unboundedFollowing)
    runs = F.col("total_runs")
    marked = hourly.withColumn("peak_so_far", F.max("total_runs").over(hours.rowsBetween(*frame))).withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.desc("total_runs"), "hour_of_day"))
    )
    return marked.select(
        "hour_of_day",
        "total_runs",
        ((F.col("_rank") == 1) & (runs > 0)).alias("is_peak"),
        ((runs > 0) & (runs < F.col("peak_so_far") * quiet_share)).alias("is_quiet"),
    ).orderBy("hour_of_day")


def dag_frequency(dag_run: DataFrame, *, as_of: AsOf, analysis_days: int = 7) -> DataFrame:
    """Runs per active day, run-time spread and time span of workflows with more than one finished run."""
    finished = dag_run.where(
        in_window("execution_date", as_of, analysis_days) & F.col("end_date").isNotNull() & F.col("start_date").isNotNull()
    )
    stats = finished.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.countDistinct(F.to_date("execution_date")).alias("active_days"),
        F.min("execution_date").alias("first_run"),
        F.max("execution_date").alias("last_run"),
        F.avg(_runtime()).alias("mean"),
        F.stddev_samp(_runtime()).alias("sd"),
    )
    return (
        stats.where(F.col("total_runs") > 1)
        .select(
            "dag_id",
            "total_runs",
            "active_days",
            F.round(ratio("total_runs", "active_days"), 2).alias("avg_runs_per_day"),
            F.round("mean", 2).alias("avg_duration_seconds"),
            F.round("sd", 2).alias("stddev_duration_seconds"),
            first_label(
                (F.col("sd") > F.col("mean") * 0.5, "High Variance"),
                (F.col("sd") > F.col("mean") * 0.3, "Medium Variance"),
                otherwise="Low Variance",
            ).alias("duration_variance"),
            hours_between("last_run", "first_run").alias("time_span_hours"),
        )
        .orderBy(F.desc("total_runs"), "dag_id")
    )


def frequency_flags(frequency: DataFrame, *, runs_per_day: float = 50.0) -> DataFrame:
    """Which workflows run very often or take very different times."""
    return frequency.select(
        "dag_id",
        "total_runs",
        "avg_runs_per_day",
        (F.col("avg_runs_per_day") > runs_per_day).alias("is_high_frequency"),
        (F.col("duration_variance") == "High Variance").alias("is_variable"),
    )


def _start_lag(dag_run: DataFrame, as_of: AsOf, analysis_days: int) -> DataFrame:
    return dag_run.where(in_window("execution_date", as_of, analysis_days) & F.col("start_date").isNotNull()).select(
        "dag_id", "state", seconds_between("start_date", "execution_date").alias("lag")
    )


def schedule_drift(
    dag_run: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    min_avg_seconds: float = 60.0,
    limit: int | None = 30,
    approximate: float | None = None,
) -> DataFrame:
    """Start minus schedule time of runs that started, worst average first.

    ``approximate`` allows a rank error (a share of the rows of a key) and takes the percentiles from sketches, in one pass.
    """
    lags = _start_lag(dag_run, as_of, analysis_days).where(F.col("state").isin("success", "failed", "running"))
    stats = (
        lags.groupBy("dag_id")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.avg("lag").alias("mean"),
            F.round(F.min("lag"), 2).alias("min_drift_seconds"),
            F.round(F.max("lag"), 2).alias("max_drift_seconds"),
            F.round(F.stddev_samp("lag"), 2).alias("stddev_drift_seconds"),
            F.count_if(F.col("lag") > 300).alias("runs_delayed_5min"),
            F.count_if(F.col("lag") > 3600).alias("runs_delayed_1hour"),
            *sketched("lag", approximate),
        )
        .where(F.col("mean") > min_avg_seconds)
    )
    order = [F.desc("mean"), F.asc("dag_id")]
    return (
        top_with_percentiles(stats, lags, ["dag_id"], "lag", {"p95": 0.95}, order, limit)
        .select(
            "dag_id",
            "run_count",
            F.round("mean", 2).alias("avg_drift_seconds"),
            "min_drift_seconds",
            "max_drift_seconds",
            "stddev_drift_seconds",
            F.round("p95", 2).alias("p95_drift_seconds"),
            "runs_delayed_5min",
            "runs_delayed_1hour",
        )
    )


def scheduling_delay(
    dag_run: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    min_avg_seconds: float = 30.0,
    limit: int | None = 30,
    approximate: float | None = None,
) -> DataFrame:
    """Start minus schedule time over all states, with median and share of late runs.

    ``approximate`` allows a rank error (a share of the rows of a key) and takes the percentiles from sketches, in one pass.
    """
    lags = _start_lag(dag_run, as_of, analysis_days)
    stats = (
        lags.groupBy("dag_id")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.avg("lag").alias("mean"),
            F.round(F.max("lag"), 2).alias("max_lag_seconds"),
            F.count_if(F.col("lag") > 300).alias("runs_with_5min_lag"),
            F.count_if(F.col("lag") > 3600).alias("runs_with_1hour_lag"),
            *sketched("lag", approximate),
        )
        .where(F.col("mean") > min_avg_seconds)
    )
    order = [F.desc("mean"), F.asc("dag_id")]
    return (
        top_with_percentiles(stats, lags, ["dag_id"], "lag", {"p50": 0.5, "p95": 0.95}, order, limit)
        .select(
            "dag_id",
            "total_runs",
            F.round("mean", 2).alias("avg_lag_seconds"),
            F.round("p50", 2).alias("median_lag_seconds"),
            F.round("p95", 2).alias("p95_lag_seconds"),
            "max_lag_seconds",
            "runs_with_5min_lag",
            "runs_with_1hour_lag",
            percent("runs_with_5min_lag", "total_runs").alias("pct_delayed_5min"),
        )
    )


def _load_summary(spans: DataFrame, as_of: AsOf, analysis_days: int, approximate: float | None) -> DataFrame:
    load = interval_load(spans, days_before(as_of, analysis_days), timestamp_lit(as_of), analysis_days + 1)
    load = load.where(F.col("load") > 0)
    if approximate is not None:
        return load.agg(
            F.max("load").alias("peak"),
            F.avg("load").alias("mean"),
            F.count(F.lit(1)).alias("sample_points"),
            *sketched("load", approximate),
        ).select("peak", "mean", "sample_points", *[quantile_of("_sketch", p).alias(f"p{round(100 * p)}") for p in (0.95, 0.99)])
    spread = load.groupBy("load").agg(F.count(F.lit(1)).alias("n"))
    totals = spread.agg(
        F.max("load").alias("peak"),
        (F.sum(F.col("load") * F.col("n")) / F.sum("n")).alias("mean"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_points"),
    )
    marks = exact_percentiles(spread.withColumn("_all", F.lit(0)), ["_all"], "load", {"p95": 0.95, "p99": 0.99}, weight="n")
    rows = totals.unionByName(marks.drop("_all"), allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("peak", "mean", "sample_points", "p95", "p99")])


def run_concurrency(
    dag_run: DataFrame, *, as_of: AsOf, analysis_days: int = 7, approximate: float | None = None
) -> DataFrame:
    """Peak, mean, p95 and p99 of runs open at the starts and ends inside the window (one row).

    ``approximate`` allows a rank error (a share of the time points) and takes the percentiles from a sketch.
    """
    spans = dag_run.select(
        F.col("start_date").alias("start"), F.col("end_date").alias("end"), F.col("dag_id").isNotNull().alias("counted")
    )
    return _load_summary(spans, as_of, analysis_days, approximate).select(
        F.col("peak").alias("max_concurrent_dags"),
        F.col("mean").alias("avg_concurrent_dags"),
        F.col("p95").alias("p95_concurrent_dags"),
        F.col("p99").alias("p99_concurrent_dags"),
    )


def task_concurrency(
    task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7, approximate: float | None = None
) -> DataFrame:
    """The same for tasks: time points of all states, load of running and queued ones only."""
    is_open = F.coalesce(F.col("state").isin("running", "queued"), F.lit(False)) & F.col("task_id").isNotNull()
    spans = task_instance.select(
        F.col("start_date").alias("start"), F.col("end_date").alias("end"), is_open.alias("counted")
    )
    return _load_summary(spans, as_of, analysis_days, approximate).select(
        F.col("peak").alias("max_concurrent_tasks"),
        F.col("mean").alias("avg_concurrent_tasks"),
        F.col("p95").alias("p95_concurrent_tasks"),
        F.col("p99").alias("p99_concurrent_tasks"),
        "sample_points",
    )


def catchup_backlog(dag_run: DataFrame, *, as_of: AsOf, limit: int | None = 30) -> DataFrame:
    """Queued runs per workflow whatever their age; runs scheduled ahead, or without a date, count too."""
    now = timestamp_lit(as_of)
    stats = (
        dag_run.where(F.col("state") == "queued")
        .groupBy("dag_id")
        .agg(
            F.count(F.lit(1)).alias("queued_runs"),
            F.min("execution_date").alias("oldest_execution_date"),
            F.max("execution_date").alias("newest_execution_date"),
        )
        .withColumn("backlog_span_hours", hours_between("newest_execution_date", "oldest_execution_date"))
        .withColumn("oldest_run_age_hours", hours_between(now, "oldest_execution_date"))
    )
    return top_rows(stats, [F.desc("queued_runs"), F.asc("dag_id")], limit)


def utilisation_vs_limit(
    run_load: DataFrame, task_load: DataFrame, *, parallelism: int = 32, max_active_runs: int = 16
) -> DataFrame:
    """Concurrency summaries against their configured limits: one row for runs, one for tasks."""
    runs = run_load.select(
        F.lit("runs").alias("scope"),
        F.lit(max_active_runs).alias("capacity"),
        F.col("max_concurrent_dags").alias("peak"),
        F.col("avg_concurrent_dags").alias("average"),
        F.col("p95_concurrent_dags").alias("p95"),
    )
    tasks = task_load.select(
        F.lit("tasks").alias("scope"),
        F.lit(parallelism).alias("capacity"),
        F.col("max_concurrent_tasks").alias("peak"),
        F.col("avg_concurrent_tasks").alias("average"),
        F.col("p95_concurrent_tasks").alias("p95"),
    )
    capacity, is_runs = F.col("capacity"), F.col("scope") == "runs"
    both = runs.unionByName(tasks).select(
        "*",
        percent("peak", "capacity").alias("peak_percent"),
        percent("average", "capacity").alias("average_percent"),
    )
    return both.withColumn(
        "label",
        first_label(
            (is_runs & (F.col("peak") > capacity * 0.8), "Peak near limit"),
            (is_runs & (F.col("p95") > capacity * 0.6), "P95 high"),
            (~is_runs & (F.col("peak") / capacity > 0.9), "Over 90%"),
            (~is_runs & (F.col("peak") / capacity > 0.75), "Over 75%"),
            (~is_runs & (F.col("average") / capacity < 0.3), "Under 30%"),
            otherwise="Normal",
        ),
    )
