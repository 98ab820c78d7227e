"""Threshold rules over operator results: one findings table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diagnostics import Settings

CRITICAL, WARNING, INFO, OK = "critical", "warning", "info", "ok"

FINDING = "domain string, severity string, code string, message string, value double"


@dataclass(frozen=True)
class Rule:
    """A finding if ``value`` over the rows of a result meets ``holds``.

    ``value`` is an aggregate; ``message`` is a format for it.
    """

    domain: str
    severity: str
    code: str
    value: Column
    holds: Column
    message: str


def _count(when: Column, more_than: int = 0) -> tuple[Column, Column]:
    return F.count_if(when).cast("double"), F.col("value") > more_than


def _rows(more_than: int = 0) -> tuple[Column, Column]:
    return F.count(F.lit(1)).cast("double"), F.col("value") > more_than


def _only(value: str | Column, low: float | None, high: float | None = None) -> tuple[Column, Column]:
    """The value of a one-row result, if above ``low`` and not above ``high``."""
    c = F.max(value).cast("double")
    v = F.col("value")
    holds = F.lit(True)
    if low is not None:
        holds = holds & (v > low)
    if high is not None:
        holds = holds & (v <= high)
    return c, holds


def _rules(s: Settings) -> dict[str, tuple[list | None, int | None, list[Rule]]]:
    """Result name -> (order, rows looked at, rules); all rows are looked at unless the settings say otherwise."""
    c = F.col
    top = s.top_n if s.cut else None
    hours = 10 if s.cut else None
    by_task = [F.asc("dag_id"), F.asc("task_id")]
    capacity = s.parallelism * 0.8 * 24
    days_left = F.when(
        (c("tasks_growth_per_day") > 0) & (c("current_avg_daily_tasks") < capacity),
        (F.lit(capacity) - c("current_avg_daily_tasks")) / c("tasks_growth_per_day"),
    )
    pool_use = c("total_connections") * 100.0 / F.lit(float(s.pool_size + s.max_overflow))
    row_days = F.when(
        (c("table_name") == "task_instance") & (c("rows_per_day") > 10_000),
        (F.lit(10_000_000.0) - c("current_rows")) / c("rows_per_day"),
    )
    is_table = lambda *names: c("table_name").isin(*names)
    rows_of = lambda *names: F.when(is_table(*names), c("row_count"))

    def rule(domain: str, severity: str, code: str, value_holds: tuple[Column, Column], message: str) -> Rule:
        return Rule(domain, severity, code, *value_holds, message)

    return {
        "error_clusters": ([F.desc("occurrence_count"), *by_task], top, [
            rule("errors", CRITICAL, "frequent_errors", _count(c("frequency_category").isin("Very High", "High")),
                 "%.0f tasks fail with high frequency"),
        ]),
        "error_correlation": (None, None, [
            rule("errors", INFO, "correlated_errors", _rows(5), "%.0f of the most frequent pairs of tasks fail together"),
        ]),
        "transient_vs_persistent": ([F.desc("retry_runs"), *by_task], top, [
            rule("errors", INFO, "transient_failures",
                 (F.count_if(c("failure_type") == "Transient").cast("double"), F.col("total") > 0),
                 "%.0f tasks usually succeed on retry"),
            rule("errors", INFO, "persistent_failures",
                 (F.count_if(c("failure_type") == "Persistent").cast("double"), F.col("total") > 0),
                 "%.0f tasks keep failing on retry"),
        ]),
        "error_time_patterns": ([F.desc("total_errors"), F.asc("hour_of_day")], hours, [
            rule("errors", WARNING, "error_spikes", _count(c("error_intensity") == "High"),
                 "%.0f hours of the day have error spikes"),
        ]),
        "failure_cascades": (None, None, [
            rule("errors", CRITICAL, "failure_cascades", _rows(), "%.0f workflows have failure cascades"),
        ]),
        "heartbeat_gaps": (None, None, [
            rule("scheduler", CRITICAL, "possible_hang", _count(c("max_gap_seconds") > 300),
                 "%.0f scheduler hosts had a heartbeat gap over 300 s"),
            rule("scheduler", WARNING, "slow_heartbeat",
                 _count((c("max_gap_seconds") <= 300) & (c("gaps_over_1min") > 10)),
                 "%.0f scheduler hosts had many heartbeat gaps over 60 s"),
        ]),
        "loop_duration": (None, None, [
            rule("scheduler", WARNING, "slow_loop", _count(c("p95_loop_duration") > 10),
                 "%.0f scheduler hosts have a p95 loop over 10 s"),
        ]),
        "queued_duration": ([F.desc("avg_queue_seconds"), *by_task], top, [
            rule("scheduler", WARNING, "long_queue", _count(c("p95_queue_seconds") > 300),
                 "%.0f tasks wait over 5 minutes in the queue"),
        ]),
        "failure_prediction": (
            [F.when(c("recent_failures") > c("old_failures"), 1).otherwise(2), F.desc("failure_rate"), *by_task], top, [
            rule("predictive", CRITICAL, "increasing_failures", _count(c("failure_trend") == "Increasing"),
                 "%.0f tasks fail more and more"),
            rule("predictive", WARNING, "high_risk_tasks",
                 _count(((c("failure_trend") == "Increasing") & (c("failure_rate") > 20))
                        | ((c("failure_trend") != "Increasing") & (c("failure_rate") > 30))),
                 "%.0f tasks are at high risk"),
        ]),
        "capacity_forecast": (None, None, [
            rule("predictive", CRITICAL, "capacity_near",
                 (F.max(days_left), F.col("value") < 30), "80 percent of capacity in %.0f days"),
            rule("predictive", WARNING, "capacity_in_sight",
                 (F.max(days_left), (F.col("value") >= 30) & (F.col("value") < 90)), "80 percent of capacity in %.0f days"),
            rule("predictive", INFO, "workload_shrinking",
                 (F.max("tasks_growth_per_day"), F.col("value") < -10), "workload changes by %.1f tasks a day"),
        ]),
        "performance_degradation": ([F.desc("duration_increase_per_week"), *by_task], top, [
            rule("predictive", WARNING, "degrading_tasks", _count(c("trend_confidence") > 0.7),
                 "%.0f tasks get slower week by week"),
        ]),
        "anomaly_detection": (None, None, [
            rule("predictive", INFO, "anomalies", _rows(), "%.0f tasks show anomalous durations"),
        ]),
        "seasonal_patterns": (None, None, [
            rule("predictive", INFO, "uneven_days", _count(c("coefficient_of_variation") > 50),
                 "%.0f weekdays have an uneven load"),
        ]),
        "sla_miss_patterns": (None, None, [
            rule("timing", WARNING, "sla_misses", _rows(), "%.0f tasks miss their deadline"),
        ]),
        "execution_variance": ([F.desc("coefficient_of_variation"), *by_task], top, [
            rule("timing", WARNING, "unsteady_durations", _count(c("coefficient_of_variation") > 50),
                 "%.0f tasks vary by more than half their mean"),
        ]),
        "schedule_drift": ([F.desc("avg_drift_seconds"), F.asc("dag_id")], top, [
            rule("timing", WARNING, "schedule_drift", _count(c("avg_drift_seconds") > 300),
                 "%.0f workflows start over 5 minutes late on average"),
        ]),
        "catchup_backlog": (None, None, [
            rule("timing", CRITICAL, "catchup_backlog", _rows(), "%.0f workflows have queued runs"),
        ]),
        "scheduling_delay": ([F.desc("avg_lag_seconds"), F.asc("dag_id")], top, [
            rule("timing", WARNING, "late_starts", _count(c("p95_lag_seconds") > 600),
                 "%.0f workflows have a p95 start delay over 10 minutes"),
        ]),
        "task_duration_trends": ([F.abs("duration_change_percent").desc(), *by_task], top, [
            rule("execution", CRITICAL, "slower_tasks", _count(c("duration_change_percent") > 20),
                 "%.0f tasks got over 20 percent slower"),
            rule("execution", OK, "faster_tasks", _count(c("duration_change_percent") < -20),
                 "%.0f tasks got over 20 percent faster"),
        ]),
        "task_retry_patterns": ([F.desc("retry_attempts"), *by_task], top, [
            rule("execution", WARNING, "frequent_retries", _count(c("retry_rate_percent") > 50),
                 "%.0f tasks retry more than half their attempts"),
        ]),
        "queue_depth": (None, None, [
            rule("execution", CRITICAL, "queue_very_deep", _only("max_queued", 100), "up to %.0f tasks queued in an hour"),
            rule("execution", WARNING, "queue_deep", _only("max_queued", 50, 100), "up to %.0f tasks queued in an hour"),
            rule("execution", WARNING, "queue_always_deep", _only("avg_queued", 20), "%.1f tasks queued on average"),
        ]),
        "executor_queue_lag": ([F.desc("avg_queue_lag_seconds"), *by_task], top, [
            rule("execution", WARNING, "executor_lag", _count(c("p95_queue_lag_seconds") > 60),
                 "%.0f tasks have a p95 queue lag over 60 s"),
        ]),
        "pool_utilisation": (None, None, [
            rule("execution", WARNING, "pools_overused", _count(F.coalesce("peak_utilization_percent", F.lit(0)) > 90),
                 "%.0f pools exceed 90 percent of their slots"),
            rule("execution", INFO, "pools_underused",
                 _count((F.coalesce("peak_utilization_percent", F.lit(0)) <= 90)
                        & (F.coalesce("avg_utilization_percent", F.lit(0)) < 20)),
                 "%.0f pools use under 20 percent of their slots"),
        ]),
        "zombie_tasks": (None, None, [
            rule("execution", CRITICAL, "zombie_tasks", _rows(), "%.0f tasks have been running for too long"),
        ]),
        "storage_footprint": (None, None, [
            rule("database", WARNING, "large_tables", _count(c("total_size_bytes") > 1_000_000_000),
                 "%.0f tables exceed 1 GB"),
        ]),
        "table_row_counts": (None, None, [
            rule("database", CRITICAL, "task_rows_urgent", _only(rows_of("task_instance"), 10_000_000),
                 "task_instance has %.0f rows"),
            rule("database", WARNING, "task_rows", _only(rows_of("task_instance"), 5_000_000, 10_000_000),
                 "task_instance has %.0f rows"),
            rule("database", WARNING, "log_rows", _only(rows_of("log"), 1_000_000), "log has %.0f rows"),
            rule("database", WARNING, "xcom_rows", _only(rows_of("xcom"), 1_000_000), "xcom has %.0f rows"),
        ]),
        "index_use": ([F.asc("index_scans"), F.desc("index_size_bytes"), F.asc("indexname")], top, [
            rule("database", INFO, "large_unused_indexes", _count(c("is_large_unused")), "%.0f large indexes are unused"),
        ]),
        "lock_waits": (None, None, [
            rule("database", CRITICAL, "many_lock_waits", _rows(5), "%.0f queries wait for locks"),
            rule("database", WARNING, "lock_waits",
                 (F.count(F.lit(1)).cast("double"), (F.col("value") > 0) & (F.col("value") <= 5)),
                 "%.0f queries wait for locks"),
        ]),
        "connection_stats": (None, None, [
            rule("database", CRITICAL, "pool_exhausted", _only(pool_use, 90), "connection pool is %.0f percent used"),
            rule("database", WARNING, "pool_busy", _only(pool_use, 75, 90), "connection pool is %.0f percent used"),
            rule("database", WARNING, "idle_transactions", _only("idle_in_transaction", 5),
                 "%.0f connections idle in a transaction"),
        ]),
        "table_growth": (None, None, [
            rule("database", WARNING, "task_rows_growing", (F.max(row_days), F.col("value") < 30),
                 "task_instance reaches 10 million rows in %.0f days"),
        ]),
        "peak_and_quiet_hours": (None, None, [
            rule("traffic", WARNING, "busy_peak_hour", _only(F.when(c("is_peak"), c("total_runs")), 100),
                 "%.0f runs in the peak hour"),
            rule("traffic", INFO, "many_quiet_hours", _count(c("is_quiet"), 8), "%.0f quiet hours"),
        ]),
        "run_concurrency": (None, None, [
            rule("traffic", WARNING, "run_limit_near", _only("max_concurrent_dags", s.max_active_runs * 0.8),
                 "up to %.0f runs at once"),
            rule("traffic", INFO, "run_load_high", _only("p95_concurrent_dags", s.max_active_runs * 0.6),
                 "p95 of %.0f runs at once"),
        ]),
        "dag_frequency": ([F.desc("total_runs"), F.asc("dag_id")], top, [
            rule("traffic", WARNING, "very_frequent_runs", _count(c("avg_runs_per_day") > 50),
                 "%.0f workflows run over 50 times a day"),
            rule("traffic", INFO, "variable_durations", _count(c("duration_variance") == "High Variance"),
                 "%.0f workflows vary strongly in duration"),
        ]),
        "task_concurrency": (None, None, [
            rule("traffic", CRITICAL, "parallelism_exceeded", _only("max_concurrent_tasks", s.parallelism * 0.9),
                 "up to %.0f tasks at once"),
            rule("traffic", WARNING, "parallelism_near",
                 _only("max_concurrent_tasks", s.parallelism * 0.75, s.parallelism * 0.9), "up to %.0f tasks at once"),
            rule("traffic", INFO, "parallelism_unused",
                 (F.max(F.when(c("max_concurrent_tasks") <= s.parallelism * 0.75, c("avg_concurrent_tasks"))),
                  F.col("value") < s.parallelism * 0.3),
                 "%.1f tasks at once on average"),
        ]),
    }


def findings(results: Mapping[str, DataFrame], settings: Settings) -> DataFrame:
    """domain, severity, code, message and value of every rule that holds; results not given are skipped.

    All rules of one result are evaluated in one aggregate over its (few) rows.
    """
    out = None
    for name, (order, rows, rules) in _rules(settings).items():
        if name not in results:
            continue
        part = _evaluated(results[name], order, rows, rules)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no results with rules were given")
    return out


def _evaluated(result: DataFrame, order: list | None, rows: int | None, rules: list[Rule]) -> DataFrame:
    if rows is not None:
        result = result.orderBy(*order).limit(rows)
    values = result.agg(F.count(F.lit(1)).alias("total"), *[r.value.alias(f"v{i}") for i, r in enumerate(rules)])
    entries = [
        F.struct(
            F.lit(r.domain).alias("domain"),
            F.lit(r.severity).alias("severity"),
            F.lit(r.code).alias("code"),
            F.format_string(r.message, F.col(f"v{i}").cast("double")).alias("message"),
            F.col(f"v{i}").cast("double").alias("value"),
            F.lit(i).alias("no"),
        )
        for i, r in enumerate(rules)
    ]
    candidates = values.select("total", F.inline(F.array(*entries)))
    holds = F.lit(False)
    for i, r in enumerate(rules):
        holds = holds | ((F.col("no") == i) & F.coalesce(r.holds, F.lit(False)))
    return candidates.where(holds & F.col("value").isNotNull()).select("domain", "severity", "code", "message", "value")


def finding_counts(found: DataFrame) -> DataFrame:
    """Findings per domain and severity."""
    return found.groupBy("domain", "severity").agg(F.count(F.lit(1)).alias("findings"))
