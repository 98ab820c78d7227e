"""Findings, recommendations, headline row and report lines."""

from __future__ import annotations

from runscope.operators import runs
from runscope.plans import diagnostics, findings, recommendations, report
from runscope.plans.settle import settled

from .bindings import AS_OF
from .q_audit import BROKEN, FOOTPRINT, HASHES, INPUTS, WAITS
from .q_failures import (
    ANOMALIES,
    CAPACITY,
    COUNTS,
    FAIL_ROWS,
    FAILURES,
    GAPS,
    PAIRS,
    PREDICTION,
)
from .q_runs import DURATIONS, FREQUENCY, HOURLY, LAG, PERFORMANCE, POOLS, RUN_ROWS, TASK_ROWS, TRENDS, WAIT, load_sql
from .register import (
    EVENTS_AS_OF,
    ORDERS_AS_OF,
    ORDERS_DAYS,
    REGISTER,
    Get,
    big,
    checkpoint_folder,
    query,
    rnd,
    uncut,
    within,
)

SETTINGS = diagnostics.Settings(
    as_of=ORDERS_AS_OF, analysis_days=ORDERS_DAYS, history_as_of=AS_OF, critical_document_mb=0.02
)

_TASK_HOURS = f"""q AS (SELECT DATE_TRUNC('hour', start_date) AS hour, COUNT(*) FILTER (WHERE state = 'queued') AS n
  FROM task_instance WHERE {TASK_ROWS} GROUP BY 1)"""
_LATE = f"""lags AS (SELECT dag_id, state, {LAG} AS lag FROM dag_run WHERE {RUN_ROWS} AND start_date IS NOT NULL)"""
_WAITS = f"""waits_in AS (SELECT dag_id, task_id, {WAIT} AS w FROM task_instance
  WHERE {within("queued_dttm", ORDERS_AS_OF, ORDERS_DAYS)} AND {WAIT} >= 0)"""


def _needs(names: set[str]) -> list[str]:
    """Tables the named results read."""
    steps = diagnostics.steps(SETTINGS)
    tables = {n for name in names if name in steps for n in steps[name][0] if n not in steps}
    if names & {"table_row_counts", "table_growth"}:
        tables |= {"task_instance", "dag_run", "log", "job", "xcom"}
    return sorted(tables)


def _results(t: Get, names: set[str], settle: bool = False):
    return diagnostics.run_diagnostics({n: t(n) for n in _needs(names)}, SETTINGS, only=names, settle=settle)


MESSAGES = {
    "frequent_errors": "%.0f tasks fail with high frequency",
    "correlated_errors": "%.0f of the most frequent pairs of tasks fail together",
    "transient_failures": "%.0f tasks usually succeed on retry",
    "persistent_failures": "%.0f tasks keep failing on retry",
    "error_spikes": "%.0f hours of the day have error spikes",
    "failure_cascades": "%.0f workflows have failure cascades",
    "possible_hang": "%.0f scheduler hosts had a heartbeat gap over 300 s",
    "slow_heartbeat": "%.0f scheduler hosts had many heartbeat gaps over 60 s",
    "slow_loop": "%.0f scheduler hosts have a p95 loop over 10 s",
    "long_queue": "%.0f tasks wait over 5 minutes in the queue",
    "increasing_failures": "%.0f tasks fail more and more",
    "high_risk_tasks": "%.0f tasks are at high risk",
    "capacity_near": "80 percent of capacity in %.0f days",
    "capacity_in_sight": "80 percent of capacity in %.0f days",
    "workload_shrinking": "workload changes by %.1f tasks a day",
    "degrading_tasks": "%.0f tasks get slower week by week",
    "anomalies": "%.0f tasks show anomalous durations",
    "uneven_days": "%.0f weekdays have an uneven load",
    "sla_misses": "%.0f tasks miss their deadline",
    "unsteady_durations": "%.0f tasks vary by more than half their mean",
    "schedule_drift": "%.0f workflows start over 5 minutes late on average",
    "catchup_backlog": "%.0f workflows have queued runs",
    "late_starts": "%.0f workflows have a p95 start delay over 10 minutes",
    "slower_tasks": "%.0f tasks got over 20 percent slower",
    "faster_tasks": "%.0f tasks got over 20 percent faster",
    "frequent_retries": "%.0f tasks retry more than half their attempts",
    "queue_very_deep": "up to %.0f tasks queued in an hour",
    "queue_deep": "up to %.0f tasks queued in an hour",
    "queue_always_deep": "%.1f tasks queued on average",
    "executor_lag": "%.0f tasks have a p95 queue lag over 60 s",
    "pools_overused": "%.0f pools exceed 90 percent of their slots",
    "pools_underused": "%.0f pools use under 20 percent of their slots",
    "zombie_tasks": "%.0f tasks have been running for too long",
    "large_tables": "%.0f tables exceed 1 GB",
    "task_rows_urgent": "task_instance has %.0f rows",
    "task_rows": "task_instance has %.0f rows",
    "log_rows": "log has %.0f rows",
    "xcom_rows": "xcom has %.0f rows",
    "large_unused_indexes": "%.0f large indexes are unused",
    "many_lock_waits": "%.0f queries wait for locks",
    "lock_waits": "%.0f queries wait for locks",
    "pool_exhausted": "connection pool is %.0f percent used",
    "pool_busy": "connection pool is %.0f percent used",
    "idle_transactions": "%.0f connections idle in a transaction",
    "task_rows_growing": "task_instance reaches 10 million rows in %.0f days",
    "busy_peak_hour": "%.0f runs in the peak hour",
    "many_quiet_hours": "%.0f quiet hours",
    "run_limit_near": "up to %.0f runs at once",
    "run_load_high": "p95 of %.0f runs at once",
    "very_frequent_runs": "%.0f workflows run over 50 times a day",
    "variable_durations": "%.0f workflows vary strongly in duration",
    "parallelism_exceeded": "up to %.0f tasks at once",
    "parallelism_near": "up to %.0f tasks at once",
    "parallelism_unused": "%.1f tasks at once on average",
}


def finding(domain: str, severity: str, code: str, value: str, source: str, holds: str = "value > 0") -> str:
    return (
        f"SELECT '{domain}' AS domain, '{severity}' AS severity, '{code}' AS code, printf('{MESSAGES[code]}', value) AS message, "
        f"value FROM (SELECT {rnd(value)} AS value FROM {source}) WHERE {holds}"
    )


CLUSTERS = f"""clusters AS (SELECT dag_id, task_id, COUNT(*) AS n FROM task_instance WHERE {TASK_ROWS} AND state = 'failed'
  GROUP BY 1, 2)"""
RETRIED = f"""rr AS (SELECT dag_id, task_id, run_id, MAX(CASE WHEN state = 'success' THEN 1 ELSE 0 END) AS ok
  FROM task_instance WHERE {TASK_ROWS} AND try_number > 1 GROUP BY 1, 2, 3),
retried AS (SELECT dag_id, task_id, COUNT(*) AS n, SUM(ok) / COUNT(*) AS share FROM rr GROUP BY 1, 2 HAVING COUNT(*) >= 5)"""
HOURS = f"""eh AS (SELECT EXTRACT(HOUR FROM start_date) AS h, COUNT(*) AS n FROM task_fail WHERE {FAIL_ROWS} GROUP BY 1)"""
CASCADES = f"""cr AS (SELECT dag_id, run_id FROM task_instance WHERE {TASK_ROWS} AND state = 'failed' GROUP BY 1, 2
  HAVING COUNT(DISTINCT task_id) >= 3),
cascades AS (SELECT dag_id, COUNT(*) AS n FROM cr GROUP BY 1)"""
ERRORS = {"error_clusters", "error_correlation", "transient_vs_persistent", "error_time_patterns", "failure_cascades"}
ERROR_CTES = f"{CLUSTERS}, {RETRIED}, {HOURS}, {CASCADES}, {PAIRS}"
ERROR_FINDINGS = " UNION ALL ".join([
    finding("errors", "critical", "frequent_errors", "COUNT(*) FILTER (WHERE n > 20)", "clusters"),
    finding("errors", "info", "correlated_errors", "LEAST(COUNT(*), 20)", "pairs", "value > 5"),
    finding("errors", "info", "transient_failures", "COUNT(*) FILTER (WHERE share > 0.8)",
            "retried", "(SELECT COUNT(*) FROM retried) > 0"),
    finding("errors", "info", "persistent_failures", "COUNT(*) FILTER (WHERE share <= 0.5)",
            "retried", "(SELECT COUNT(*) FROM retried) > 0"),
    finding("errors", "warning", "error_spikes", "COUNT(*) FILTER (WHERE n > (SELECT AVG(n) * 1.5 FROM eh))",
            "eh"),
    finding("errors", "critical", "failure_cascades", "COUNT(*)", "cascades"),
])


@query("i01_findings_errors", ["task_instance", "task_fail"], f"WITH {ERROR_CTES} {ERROR_FINDINGS}")
def _(t: Get):
    return findings.findings(_results(t, ERRORS), SETTINGS)


@query("i01_findings_scheduler", ["job", "task_instance"], f"""WITH {GAPS}, {_WAITS},
lq AS (SELECT dag_id, task_id, AVG(w) AS mean, QUANTILE_CONT(w, 0.95) AS p95 FROM waits_in GROUP BY 1, 2
       HAVING AVG(w) > 10),
loops AS (SELECT hostname, QUANTILE_CONT(gap, 0.95) AS p95 FROM b WHERE gap > 0 GROUP BY 1)
""" + " UNION ALL ".join([
    finding("scheduler", "critical", "possible_hang", "COUNT(*) FILTER (WHERE max_gap_seconds > 300)", "g"),
    finding("scheduler", "warning", "slow_heartbeat",
            "COUNT(*) FILTER (WHERE max_gap_seconds <= 300 AND gaps_over_1min > 10)", "g"),
    finding("scheduler", "warning", "slow_loop", "COUNT(*) FILTER (WHERE p95 > 10)", "loops"),
    finding("scheduler", "warning", "long_queue", "COUNT(*) FILTER (WHERE p95 > 300)", "lq"),
]))
def _(t: Get):
    names = {"heartbeat_gaps", "loop_duration", "queued_duration"}
    return findings.findings(_results(t, names), SETTINGS)


_DAYS_LEFT = ("MAX(CASE WHEN tasks_growth_per_day > 0 AND current_avg_daily_tasks < 614.4 "
              "THEN (614.4 - current_avg_daily_tasks) / tasks_growth_per_day END)")


@query("i01_findings_predictive", ["task_instance"], f"""WITH {uncut(PREDICTION)}, {CAPACITY}, {DURATIONS},
first AS (SELECT * FROM prediction),
w AS (SELECT dag_id, task_id, DATE_TRUNC('week', start_date) AS week, AVG(s) AS y FROM d GROUP BY 1, 2, 3
      HAVING COUNT(*) >= 3),
tr AS (SELECT dag_id, task_id, REGR_SLOPE(y, epoch(week) / 604800.0) AS slope, REGR_R2(y, epoch(week) / 604800.0) AS fit
       FROM w GROUP BY 1, 2 HAVING COUNT(*) >= 3),
slower AS (SELECT * FROM tr WHERE slope > 0 AND fit > 0.3),
odd AS (SELECT * FROM (SELECT 1 AS one FROM ({"WITH " + ANOMALIES} FROM z WHERE z > 3 GROUP BY 1, 2))),
cells AS (SELECT EXTRACT(DOW FROM start_date) AS d, EXTRACT(HOUR FROM start_date) AS h, COUNT(*) AS n FROM task_instance
  WHERE {TASK_ROWS} AND end_date IS NOT NULL AND state = 'success' GROUP BY 1, 2),
seasons AS (SELECT d, {rnd("STDDEV_SAMP(n) / AVG(n) * 100", 2)} AS cv FROM cells GROUP BY d)
""" + " UNION ALL ".join([
    finding("predictive", "critical", "increasing_failures", "COUNT(*) FILTER (WHERE failure_trend = 'Increasing')", "first"),
    finding("predictive", "warning", "high_risk_tasks",
            "COUNT(*) FILTER (WHERE failure_trend = 'Increasing' AND failure_rate > 20 "
            "OR failure_trend <> 'Increasing' AND failure_rate > 30)", "first"),
    finding("predictive", "critical", "capacity_near", _DAYS_LEFT, "capacity", "value < 30"),
    finding("predictive", "warning", "capacity_in_sight", _DAYS_LEFT, "capacity", "value >= 30 AND value < 90"),
    finding("predictive", "info", "workload_shrinking", "MAX(tasks_growth_per_day)", "capacity", "value < -10"),
    finding("predictive", "warning", "degrading_tasks", f"COUNT(*) FILTER (WHERE {rnd('fit', 4)} > 0.7)", "slower"),
    finding("predictive", "info", "anomalies", "COUNT(*)", "odd"),
    finding("predictive", "info", "uneven_days", "COUNT(*) FILTER (WHERE cv > 50)", "seasons"),
]))
def _(t: Get):
    names = {
        "failure_prediction", "capacity_forecast", "performance_degradation", "anomaly_detection", "seasonal_patterns"
    }
    return findings.findings(_results(t, names), SETTINGS)


@query("i01_findings_timing", ["sla_miss", "task_instance", "dag_run"], f"""WITH {DURATIONS}, {_LATE},
sla AS (SELECT dag_id, task_id FROM sla_miss WHERE {within('"timestamp"', EVENTS_AS_OF, ORDERS_DAYS)} GROUP BY 1, 2),
cv AS (SELECT {rnd("STDDEV_SAMP(s) / AVG(s) * 100", 2)} AS cv FROM d GROUP BY dag_id, task_id
       HAVING COUNT(*) >= 5 AND STDDEV_SAMP(s) IS NOT NULL),
drift AS (SELECT AVG(lag) AS mean FROM lags WHERE state IN ('success', 'failed', 'running') GROUP BY dag_id
          HAVING AVG(lag) > 60),
late AS (SELECT {rnd("AVG(lag)", 2)} AS mean, dag_id, QUANTILE_CONT(lag, 0.95) AS p95 FROM lags GROUP BY dag_id
         HAVING AVG(lag) > 30),
backlog AS (SELECT dag_id FROM dag_run WHERE state = 'queued' GROUP BY 1)
""" + " UNION ALL ".join([
    finding("timing", "warning", "sla_misses", "COUNT(*)", "sla"),
    finding("timing", "warning", "unsteady_durations", "COUNT(*) FILTER (WHERE cv > 50)", "cv"),
    finding("timing", "warning", "schedule_drift", "COUNT(*) FILTER (WHERE mean > 300)", "drift"),
    finding("timing", "critical", "catchup_backlog", "COUNT(*)", "backlog"),
    finding("timing", "warning", "late_starts", "COUNT(*) FILTER (WHERE p95 > 600)", "late"),
]))
def _(t: Get):
    names = {"sla_miss_patterns", "execution_variance", "schedule_drift", "catchup_backlog", "scheduling_delay"}
    return findings.findings(_results(t, names), SETTINGS)


@query("i01_findings_execution", ["task_instance", "slot_pool"], f"""WITH {uncut(TRENDS)}, {_TASK_HOURS}, {POOLS},
changes AS (SELECT {rnd("change * 100", 2)} AS change, dag_id, task_id FROM trend),
retries AS (SELECT dag_id, task_id, COUNT(*) FILTER (WHERE try_number > 1) AS n,
                   {rnd("COUNT(*) FILTER (WHERE try_number > 1) * 100.0 / COUNT(*)", 2)} AS rate
            FROM task_instance WHERE {TASK_ROWS} GROUP BY 1, 2),
ql AS (SELECT dag_id, task_id, {rnd(f"AVG({WAIT})", 2)} AS mean, QUANTILE_CONT({WAIT}, 0.95) AS p95 FROM task_instance
       WHERE {TASK_ROWS} AND state IN ('success', 'failed', 'running') AND {WAIT} >= 0 GROUP BY 1, 2 HAVING COUNT(*) >= 5),
stuck AS (SELECT * FROM task_instance WHERE state = 'running' AND start_date < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 6 HOUR)
""" + " UNION ALL ".join([
    finding("execution", "critical", "slower_tasks", "COUNT(*) FILTER (WHERE change > 20)",
            "changes"),
    finding("execution", "ok", "faster_tasks", "COUNT(*) FILTER (WHERE change < -20)",
            "changes"),
    finding("execution", "warning", "frequent_retries", "COUNT(*) FILTER (WHERE rate > 50)",
            "retries"),
    finding("execution", "critical", "queue_very_deep", "MAX(n)", "q", "value > 100"),
    finding("execution", "warning", "queue_deep", "MAX(n)", "q", "value > 50 AND value <= 100"),
    finding("execution", "warning", "queue_always_deep", "AVG(n)", "q", "value > 20"),
    finding("execution", "warning", "executor_lag", "COUNT(*) FILTER (WHERE p95 > 60)",
            "ql"),
    finding("execution", "warning", "pools_overused", "COUNT(*) FILTER (WHERE COALESCE(peak_utilization_percent, 0) > 90)",
            "pools"),
    finding("execution", "info", "pools_underused", "COUNT(*) FILTER (WHERE COALESCE(peak_utilization_percent, 0) <= 90 "
            "AND COALESCE(avg_utilization_percent, 0) < 20)", "pools"),
    finding("execution", "critical", "zombie_tasks", "COUNT(*)", "stuck"),
]))
def _(t: Get):
    names = {
        "task_duration_trends", "task_retry_patterns", "queue_depth", "executor_queue_lag", "pool_utilisation", "zombie_tasks"
    }
    return findings.findings(_results(t, names), SETTINGS)


DATABASE = {"storage_footprint", "table_row_counts", "index_use", "lock_waits", "connection_stats", "table_growth"}


@query("i01_findings_database",
       ["table_sizes", "task_instance", "dag_run", "log", "job", "xcom", "index_usage", "activity", "locks"],
       f"""WITH {uncut(FOOTPRINT)}, {COUNTS}, {WAITS},
idx AS (SELECT * FROM index_usage),
conns AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE state = 'idle in transaction') AS idle FROM activity),
grow AS (SELECT COUNT(*) AS n, {rnd(f"COUNT(*) FILTER (WHERE {within('execution_date', ORDERS_AS_OF, 365)}) / 365", 2)} AS d
         FROM task_instance)
""" + " UNION ALL ".join([
    finding("database", "warning", "large_tables", "COUNT(*) FILTER (WHERE total_size_bytes > 1000000000)", "f"),
    finding("database", "critical", "task_rows_urgent", "MAX(row_count) FILTER (WHERE table_name = 'task_instance')",
            "counts", "value > 10000000"),
    finding("database", "warning", "task_rows", "MAX(row_count) FILTER (WHERE table_name = 'task_instance')",
            "counts", "value > 5000000 AND value <= 10000000"),
    finding("database", "warning", "log_rows", "MAX(row_count) FILTER (WHERE table_name = 'log')", "counts", "value > 1000000"),
    finding("database", "warning", "xcom_rows", "MAX(row_count) FILTER (WHERE table_name = 'xcom')", "counts",
            "value > 1000000"),
    finding("database", "info", "large_unused_indexes",
            "COUNT(*) FILTER (WHERE index_scans = 0 AND index_size_bytes > 10000000)", "idx"),
    finding("database", "critical", "many_lock_waits", "COUNT(*)", "waits", "value > 5"),
    finding("database", "warning", "lock_waits", "COUNT(*)", "waits", "value > 0 AND value <= 5"),
    finding("database", "critical", "pool_exhausted", "n * 100.0 / 15", "conns", "value > 90"),
    finding("database", "warning", "pool_busy", "n * 100.0 / 15", "conns", "value > 75 AND value <= 90"),
    finding("database", "warning", "idle_transactions", "idle", "conns", "value > 5"),
    finding("database", "warning", "task_rows_growing", "CASE WHEN d > 10000 THEN (10000000 - n) / d END", "grow", "value < 30"),
]))
def _(t: Get):
    return findings.findings(_results(t, DATABASE), SETTINGS)


TRAFFIC = {"hourly_traffic", "peak_and_quiet_hours", "run_concurrency", "dag_frequency", "task_concurrency"}
LOAD_CTES = f"""run_load AS ({load_sql("dag_run", "", "MAX(n) AS peak, QUANTILE_CONT(n, 0.95) AS p95", ORDERS_DAYS)}),
task_load AS ({load_sql("task_instance", "AND state IN ('running', 'queued')", "MAX(n) AS peak, AVG(n) AS mean", ORDERS_DAYS)})"""
HOUR_CTES = f"""{HOURLY}, quiet AS (SELECT *, MAX(total_runs) OVER (ORDER BY hour_of_day) AS so_far FROM hourly)"""
TRAFFIC_FINDINGS = " UNION ALL ".join([
    finding("traffic", "warning", "busy_peak_hour", "MAX(total_runs)", "hourly", "value > 100"),
    finding("traffic", "info", "many_quiet_hours",
            "COUNT(*) FILTER (WHERE total_runs > 0 AND total_runs < so_far * 0.1)", "quiet", "value > 8"),
    finding("traffic", "warning", "run_limit_near", "peak", "run_load", "value > 12.8"),
    finding("traffic", "info", "run_load_high", "p95", "run_load", "value > 9.6"),
    finding("traffic", "warning", "very_frequent_runs",
            f"COUNT(*) FILTER (WHERE {rnd('total_runs / active_days', 2)} > 50)", "freq"),
    finding("traffic", "info", "variable_durations", "COUNT(*) FILTER (WHERE sd > mean * 0.5)",
            "freq"),
    finding("traffic", "critical", "parallelism_exceeded", "peak", "task_load", "value > 28.8"),
    finding("traffic", "warning", "parallelism_near", "peak", "task_load", "value > 24 AND value <= 28.8"),
    finding("traffic", "info", "parallelism_unused", "CASE WHEN peak <= 24 THEN mean END", "task_load", "value < 9.6"),
])


@query("i01_findings_traffic", ["dag_run", "task_instance"],
       f"WITH {HOUR_CTES}, {FREQUENCY}, {LOAD_CTES} {TRAFFIC_FINDINGS}")
def _(t: Get):
    return findings.findings(_results(t, TRAFFIC), SETTINGS)


# results that the recommendation, headline and report queries go by
ADVISED = ERRORS | {
    "run_performance", "task_failures", "catchup_backlog", "zombie_tasks", "queue_depth", "config_conflicts",
    "config_change", "document_size_status", "serialization_instability", "inventory_summary",
}
ADVICE_TABLES = [
    "task_instance", "task_fail", "dag_run", "settings", "serialized_dag", "file_inventory"
]
_MB = "strlen(data) / 1048576.0"
ADVICE_CTES = f"""{ERROR_CTES}, {PERFORMANCE}, {uncut(FAILURES)}, {_TASK_HOURS}, {INPUTS}, {HASHES},
stuck AS (SELECT 1 FROM task_instance WHERE state = 'running' AND start_date < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 6 HOUR),
backlog AS (SELECT dag_id, COUNT(*) AS n FROM dag_run WHERE state = 'queued' GROUP BY 1),
found AS ({ERROR_FINDINGS} UNION ALL {finding("timing", "critical", "catchup_backlog", "COUNT(*)", "backlog")}
  UNION ALL {finding("execution", "critical", "zombie_tasks", "COUNT(*)", "stuck")}
  UNION ALL {finding("execution", "critical", "queue_very_deep", "MAX(n)", "q", "value > 100")}
  UNION ALL {finding("execution", "warning", "queue_deep", "MAX(n)", "q", "value > 50 AND value <= 100")}
  UNION ALL {finding("execution", "warning", "queue_always_deep", "AVG(n)", "q", "value > 20")}),
broken AS ({BROKEN}),
changes AS (SELECT config_hash, LAG(config_hash) OVER (PARTITION BY env ORDER BY captured_at) AS before FROM hashes),
unstable AS (SELECT dag_id FROM serialized_dag WHERE {within("last_updated", EVENTS_AS_OF, ORDERS_DAYS)}
             GROUP BY 1 HAVING COUNT(DISTINCT dag_hash) > 3),
files AS (SELECT COUNT(*) FILTER (WHERE NOT ends_with(path, '.py')) AS others,
                 {rnd("SUM(size_bytes) / 1048576", 2)} AS mb,
                 {rnd("SUM(size_bytes) FILTER (WHERE NOT ends_with(path, '.py')) / 1048576", 2)} AS other_mb
          FROM file_inventory)"""


def _of(domain: str, severity: str) -> str:
    return f"SELECT COUNT(*) FILTER (WHERE domain = '{domain}' AND severity = '{severity}') AS v FROM found"


# (rule number, value, comparison, message) of the rules these results can fire
ADVICE = [
    (1, _of("errors", "critical"), "> 0", "Urgent: fix %.0f critical error patterns"),
    (2, "SELECT COUNT(*) AS v FROM cascades", "> 0", "Improve error handling of %.0f workflows with failure cascades"),
    (4, "SELECT COUNT(*) AS v FROM broken WHERE severity = 'CRITICAL'", "> 0",
     "Urgent: resolve %.0f critical configuration conflicts"),
    (5, "SELECT COUNT(*) AS v FROM broken WHERE severity = 'WARNING'", "> 0", "Review %.0f configuration warnings"),
    (6, "SELECT COUNT(*) FILTER (WHERE before <> config_hash) AS v FROM changes", "> 0",
     "Check the effect of %.0f recent configuration changes"),
    (7, f"SELECT {rnd(f'MAX({_MB})')} AS v FROM serialized_dag", "> 0.02",
     "Make large workflows smaller, the largest takes %.1f MB"),
    (8, "SELECT AVG(success_rate_percent) AS v FROM perf", "< 95",
     "Investigate failing runs, the success rate is %.1f percent"),
    (9, "SELECT COUNT(*) AS v FROM fails", "> 10", "Review %.0f failing tasks"),
    (10, "SELECT COUNT(*) AS v FROM unstable", "> 0", "Investigate %.0f workflows whose document keeps changing"),
    (14, _of("timing", "critical"), "> 0", "Urgent: address %.0f critical timing issues"),
    (16, "SELECT SUM(n) AS v FROM backlog", "> 50", "Clear the backlog of %.0f queued runs"),
    (17, _of("execution", "critical"), "> 0", "Urgent: address %.0f critical task execution issues"),
    (18, _of("execution", "warning"), "> 0", "Review %.0f task execution warnings"),
    (19, "SELECT COUNT(*) AS v FROM stuck", "> 0", "Clear %.0f tasks stuck in the running state"),
    (20, "SELECT MAX(n) AS v FROM q", "> 100", "Raise parallelism or worker capacity, up to %.0f tasks were queued"),
    (28, "SELECT 1 AS v", "> 0", "Add an ignore file to keep other files from being parsed"),
    (29, "SELECT others AS v FROM files", "> 0", "Review %.0f non-Python files in the workflow folder"),
    (30, "SELECT mb AS v FROM files", "> 100", "Clean up the workflow folder of %.2f MB"),
    (31, "SELECT other_mb AS v FROM files", "> 10", "Move data files of %.2f MB out of the workflow folder"),
]


def _advice_row(no: int, value: str, comparison: str, message: str) -> str:
    text = f"printf('{message}', CAST(v AS DOUBLE))" if "%" in message else f"'{message}'"
    return f"SELECT {big(str(no))} AS rule_no, {text} AS recommendation FROM ({value}) WHERE v {comparison}"


ADVICE_SQL = " UNION ALL ".join(_advice_row(*rule) for rule in ADVICE)


def _advice(t: Get):
    checkpoint_folder(t("orders").sparkSession)
    results = _results(t, ADVISED, settle=True)
    found = settled(findings.findings(results, SETTINGS))
    numbers = recommendations.headline_numbers(results, found)
    return results, found, numbers, recommendations.recommendations(numbers, SETTINGS)


@query("i02_recommendations", ADVICE_TABLES, f"""WITH {ADVICE_CTES}, fired AS ({ADVICE_SQL})
SELECT ROW_NUMBER() OVER (ORDER BY rule_no) AS position, * FROM fired""")
def _(t: Get):
    return _advice(t)[3]


@query("i03_report_summary", ADVICE_TABLES, f"""WITH {ADVICE_CTES}, fired AS ({ADVICE_SQL})
SELECT (SELECT COUNT(*) FROM serialized_dag) AS total_dags,
       (SELECT COUNT(*) FROM serialized_dag WHERE {_MB} > 0.025 AND {rnd(_MB, 2)} > 0.02) AS suspicious_dags,
       (SELECT COUNT(*) FROM perf WHERE success_rate_percent < 95 OR avg_rt > 3600) AS performance_issues,
       (SELECT COUNT(*) FROM fails) AS failing_tasks, (SELECT COUNT(*) FROM unstable) AS unstable_dags,
       (SELECT COUNT(*) FILTER (WHERE before <> config_hash) > 0 FROM changes) AS config_changed,
       {big("0")} AS traffic_insights, {big("0")} AS peak_concurrent_dags, {big("0")} AS peak_concurrent_tasks,
       (SELECT COUNT(*) FROM fired) AS recommendations_count""")
def _(t: Get):
    results, found, numbers, advice = _advice(t)
    return report.report_summary(numbers, runs.run_health_status(results["run_performance"], top_n=None), found, advice)


@query("i04_report_lines")
def _(t: Get):
    results, found, _, advice = _advice(t)
    return report.report_lines(results, found, advice)




# sections of the text report whose lines show numbers as their results have them: result, query, order, line
_T, _D = "printf('%-42s', dag_id || '.' || task_id)", "printf('%-35s', dag_id)"
SHOWN = [
    ("SCHEDULE DRIFT", "schedule_drift", "a07_schedule_drift", "avg_drift_seconds DESC, dag_id",
     _D + " || printf(' %8d runs, drift %10.2f s, p95 %10.2f s', run_count, avg_drift_seconds, p95_drift_seconds)"),
    ("SCHEDULING DELAY", "scheduling_delay", "a08_scheduling_delay", "avg_lag_seconds DESC, dag_id",
     _D + " || printf(' %8d runs, delay %10.2f s, p95 %10.2f s, %.2f %% over 5 min', total_runs, avg_lag_seconds, p95_lag_seconds, pct_delayed_5min)"),
    ("RETRIES", "task_retry_patterns", "b03_task_retry_patterns", "retry_attempts DESC, dag_id, task_id",
     _T + " || printf(' %8d retries, %.2f %% of attempts', retry_attempts, retry_rate_percent)"),
    ("EXECUTOR LAG", "executor_queue_lag", "b05_executor_queue_lag", "avg_queue_lag_seconds DESC, dag_id, task_id",
     _T + " || printf(' %10.2f s, p95 %10.2f s', avg_queue_lag_seconds, p95_queue_lag_seconds)"),
    ("TIME IN QUEUE", "queued_duration", "b06_queued_duration", "avg_queue_seconds DESC, dag_id, task_id",
     _T + " || printf(' %10.2f s, p95 %10.2f s', avg_queue_seconds, p95_queue_seconds)"),
    ("TASK FAILURES", "task_failures", "c01_task_failures", "failure_count DESC, dag_id, task_id",
     _T + " || printf(' %8d failures on %d days', failure_count, failure_days)"),
    ("ERROR CLUSTERS", "error_clusters", "c03_error_clusters", "occurrence_count DESC, dag_id, task_id",
     _T + " || printf(' %8d ', occurrence_count) || frequency_category"),
    ("ERRORS TOGETHER", "error_correlation", "c04_error_correlation", "co_occurrence_count DESC, task1, task2",
     "task1 || ' and ' || task2 || printf(': %d times', co_occurrence_count)"),
    ("RETRY OUTCOMES", "transient_vs_persistent", "c05_transient_vs_persistent", "retry_runs DESC, dag_id, task_id",
     _T + " || printf(' %8d retried runs, %.2f %% succeed, ', retry_runs, retry_success_rate) || failure_type"),
    ("ERROR HOURS", "error_time_patterns", "c06_error_time_patterns", "total_errors DESC, hour_of_day",
     "printf('%02d:00 %8d errors, ', hour_of_day, total_errors) || error_intensity"),
    ("FAILURE CASCADES", "failure_cascades", "c07_failure_cascades", "cascade_count DESC, dag_id",
     _D + " || printf(' %8d cascades, %.2f tasks on average', cascade_count, avg_tasks_per_cascade)"),
    ("FAILURE FORECAST", "failure_prediction", "d01_failure_prediction", "failure_rate DESC, dag_id, task_id",
     _T + " || printf(' %6.2f %% fail, ', failure_rate) || failure_trend"),
    ("SCHEDULER LOOPS", "loop_duration", "d09_loop_duration", "p95_loop_duration DESC, hostname",
     "printf('%-20s', hostname) || printf(' %8d loops, p95 %.2f s', loop_count, p95_loop_duration)"),
]


def _shown_sql() -> str:
    parts = []
    for no, (title, _, name, order, line) in enumerate(SHOWN, start=1):
        parts.append(f"SELECT {no} AS section, 0 AS line_no, '{title}' AS text")
        parts.append(
            f"SELECT {no}, line_no, text FROM (SELECT ROW_NUMBER() OVER (ORDER BY {order}) AS line_no, {line} AS text "
            f"FROM ({REGISTER[name].sql})) WHERE line_no <= 12"
        )
    for no, title in enumerate(("FINDINGS", "RECOMMENDATIONS"), start=len(SHOWN) + 1):
        parts.append(f"SELECT {no}, 0, '{title}'")
    lines = " UNION ALL ".join(parts)
    return f"SELECT {big('section')} AS section, {big('line_no')} AS line_no, text FROM ({lines})"


@query("i04_report_sections", [], _shown_sql())
def _(t: Get):
    """The sections above from the registered results; nothing was found and nothing is advised."""
    results = {result: REGISTER[name].build(t) for _, result, name, *_ in SHOWN}
    spark = t("orders").sparkSession
    none = spark.createDataFrame([], findings.FINDING)
    nothing = spark.createDataFrame([], "position int, rule_no int, recommendation string")
    return report.report_lines(results, none, nothing, rows_per_section=12)
