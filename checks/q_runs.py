"""Run and task queries."""

from __future__ import annotations

from runscope.operators import runs, tasks

from .register import LOAD_DAYS, ORDERS_AS_OF, ORDERS_DAYS, EVENTS_AS_OF, EVENTS_DAYS, Get, big, query, rnd, sec, within

RUN = {"as_of": ORDERS_AS_OF, "analysis_days": ORDERS_DAYS}
EVENT = {"as_of": EVENTS_AS_OF, "analysis_days": EVENTS_DAYS}
RUN_ROWS = within("execution_date", ORDERS_AS_OF, ORDERS_DAYS)
TASK_ROWS = within("start_date", ORDERS_AS_OF, ORDERS_DAYS)
RUNTIME = sec("end_date", "start_date")
LAG = sec("start_date", "execution_date")
WAIT = sec("start_date", "queued_dttm")
SPLIT = f"CAST(TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL {ORDERS_DAYS // 2} DAY AS DATE)"

PERFORMANCE = f"""perf AS (
  SELECT dag_id, COUNT(*) AS total_runs, COUNT(*) FILTER (WHERE state = 'success') AS successful_runs,
         COUNT(*) FILTER (WHERE state = 'failed') AS failed_runs,
         COUNT(*) FILTER (WHERE state = 'running') AS running_runs,
         COUNT(*) FILTER (WHERE state = 'queued') AS queued_runs,
         {rnd("COUNT(*) FILTER (WHERE state = 'success') * 100.0 / COUNT(*)", 2)} AS success_rate_percent,
         AVG({RUNTIME}) AS avg_rt, MAX({RUNTIME}) AS max_rt, MIN({RUNTIME}) AS min_rt,
         COUNT(DISTINCT CAST(execution_date AS DATE)) AS active_days
  FROM dag_run WHERE {RUN_ROWS} GROUP BY dag_id)"""


@query("a01_run_performance", ["dag_run"], f"""WITH {PERFORMANCE}
SELECT dag_id, total_runs, successful_runs, failed_runs, running_runs, queued_runs, success_rate_percent,
       {rnd("avg_rt")} AS avg_runtime_seconds, {rnd("max_rt")} AS max_runtime_seconds,
       {rnd("min_rt")} AS min_runtime_seconds, active_days FROM perf""")
def _(t: Get):
    return runs.run_performance(t("dag_run"), **RUN)


@query("a02_run_health_status", ["dag_run"], f"""WITH {PERFORMANCE},
top AS (SELECT * FROM perf ORDER BY total_runs DESC, dag_id LIMIT 20)
SELECT dag_id, total_runs, success_rate_percent, {rnd("avg_rt")} AS avg_runtime_seconds,
       CASE WHEN COALESCE(avg_rt, 0) < 3600 THEN printf('%.1fm', COALESCE(avg_rt, 0) / 60)
            ELSE printf('%.1fh', avg_rt / 3600) END AS avg_runtime,
       CASE WHEN success_rate_percent < 70 THEN 'Critical' WHEN success_rate_percent < 80 THEN 'Warning'
            WHEN avg_rt > 3500 THEN 'Warning' ELSE 'Healthy' END AS status,
       array_to_string(list_filter([CASE WHEN success_rate_percent < 70 THEN 'LOW_SUCCESS_RATE' END,
            CASE WHEN avg_rt > 3500 THEN 'LONG_RUNTIME' END], lambda x: x IS NOT NULL), ',') AS issues
FROM top""")
def _(t: Get):
    performance = runs.run_performance(t("dag_run"), **RUN)
    return runs.run_health_status(
        performance, min_success_rate=70.0, warn_success_rate=80.0, long_runtime_seconds=3500.0
    )


@query("a03_success_rate_histogram", ["dag_run"], f"""WITH {PERFORMANCE},
b AS (SELECT CASE WHEN success_rate_percent < 50 THEN 1 WHEN success_rate_percent < 80 THEN 2
                  WHEN success_rate_percent < 95 THEN 3 ELSE 4 END AS n FROM perf),
labels(n, bucket) AS (VALUES (1, '<50%'), (2, '50-80%'), (3, '80-95%'), (4, '95-100%'))
SELECT {big("l.n - 1")} AS bucket_no, l.bucket, COUNT(b.n) AS dags
FROM labels l LEFT JOIN b ON l.n = b.n GROUP BY l.n, l.bucket""")
def _(t: Get):
    return runs.success_rate_histogram(runs.run_performance(t("dag_run"), **RUN))


@query("a03_average_success_rate", ["dag_run"], f"""WITH {PERFORMANCE}
SELECT COUNT(*) AS active_dags, {rnd("AVG(success_rate_percent)")} AS avg_success_rate FROM perf""")
def _(t: Get):
    return runs.average_success_rate(runs.run_performance(t("dag_run"), **RUN))


HOURLY = f"""cells AS (
  SELECT EXTRACT(HOUR FROM execution_date) AS h, EXTRACT(DOW FROM execution_date) AS d, COUNT(*) AS n,
         COUNT(DISTINCT dag_id) AS u, AVG({RUNTIME}) AS s
  FROM dag_run WHERE {RUN_ROWS} GROUP BY 1, 2),
hourly AS (SELECT {big("h")} AS hour_of_day, {big("SUM(n)")} AS total_runs, AVG(n) AS a, MAX(n) AS m, AVG(u) AS au,
                  AVG(s) AS s FROM cells GROUP BY h)"""


@query("a04_hourly_traffic", ["dag_run"], f"""WITH {HOURLY}
SELECT hour_of_day, total_runs, {rnd("a")} AS avg_runs_per_day, m AS max_runs_in_hour, {rnd("au")} AS avg_unique_dags,
       {rnd("s")} AS avg_duration_seconds FROM hourly""")
def _(t: Get):
    return runs.hourly_traffic(t("dag_run"), **RUN)


@query("a05_peak_and_quiet_hours", ["dag_run"], f"""WITH {HOURLY},
m AS (SELECT *, MAX(total_runs) OVER (ORDER BY hour_of_day) AS so_far,
             ROW_NUMBER() OVER (ORDER BY total_runs DESC, hour_of_day) AS rk FROM hourly)
SELECT hour_of_day, total_runs, rk = 1 AND total_runs > 0 AS is_peak,
       total_runs > 0 AND total_runs < so_far * 0.95 AS is_quiet FROM m""")
def _(t: Get):
    return runs.peak_and_quiet_hours(runs.hourly_traffic(t("dag_run"), **RUN), quiet_share=0.95)


FREQUENCY = f"""freq AS (
  SELECT dag_id, COUNT(*) AS total_runs, COUNT(DISTINCT CAST(execution_date AS DATE)) AS active_days,
         AVG({RUNTIME}) AS mean, STDDEV_SAMP({RUNTIME}) AS sd, MIN(execution_date) AS a, MAX(execution_date) AS b
  FROM dag_run WHERE {RUN_ROWS} AND end_date IS NOT NULL AND start_date IS NOT NULL
  GROUP BY dag_id HAVING COUNT(*) > 1)"""


@query("a06_dag_frequency", ["dag_run"], f"""WITH {FREQUENCY}
SELECT dag_id, total_runs, active_days, {rnd("total_runs / active_days", 2)} AS avg_runs_per_day,
       {rnd("mean", 2)} AS avg_duration_seconds, {rnd("sd", 2)} AS stddev_duration_seconds,
       CASE WHEN sd > mean * 0.5 THEN 'High Variance' WHEN sd > mean * 0.3 THEN 'Medium Variance'
            ELSE 'Low Variance' END AS duration_variance,
       {rnd(sec("b", "a") + " / 3600")} AS time_span_hours FROM freq""")
def _(t: Get):
    return runs.dag_frequency(t("dag_run"), **RUN)


@query("a06_frequency_flags", ["dag_run"], f"""WITH {FREQUENCY}
SELECT dag_id, total_runs, {rnd("total_runs / active_days", 2)} AS avg_runs_per_day,
       {rnd("total_runs / active_days", 2)} > 1.3 AS is_high_frequency, sd > mean * 0.5 AS is_variable FROM freq""")
def _(t: Get):
    return runs.frequency_flags(runs.dag_frequency(t("dag_run"), **RUN), runs_per_day=1.3)


@query("a07_schedule_drift", ["dag_run"], f"""
SELECT dag_id, COUNT(*) AS run_count, {rnd(f"AVG({LAG})", 2)} AS avg_drift_seconds,
       {rnd(f"MIN({LAG})", 2)} AS min_drift_seconds, {rnd(f"MAX({LAG})", 2)} AS max_drift_seconds,
       {rnd(f"STDDEV_SAMP({LAG})", 2)} AS stddev_drift_seconds,
       {rnd(f"QUANTILE_CONT({LAG}, 0.95)", 2)} AS p95_drift_seconds,
       COUNT(*) FILTER (WHERE {LAG} > 300) AS runs_delayed_5min,
       COUNT(*) FILTER (WHERE {LAG} > 3600) AS runs_delayed_1hour
FROM dag_run WHERE {RUN_ROWS} AND start_date IS NOT NULL AND state IN ('success', 'failed', 'running')
GROUP BY dag_id HAVING AVG({LAG}) > 60 ORDER BY AVG({LAG}) DESC, dag_id LIMIT 30""")
def _(t: Get):
    return runs.schedule_drift(t("dag_run"), **RUN)


@query("a08_scheduling_delay", ["dag_run"], f"""
SELECT dag_id, COUNT(*) AS total_runs, {rnd(f"AVG({LAG})", 2)} AS avg_lag_seconds,
       {rnd(f"QUANTILE_CONT({LAG}, 0.5)", 2)} AS median_lag_seconds,
       {rnd(f"QUANTILE_CONT({LAG}, 0.95)", 2)} AS p95_lag_seconds, {rnd(f"MAX({LAG})", 2)} AS max_lag_seconds,
       COUNT(*) FILTER (WHERE {LAG} > 300) AS runs_with_5min_lag,
       COUNT(*) FILTER (WHERE {LAG} > 3600) AS runs_with_1hour_lag,
       {rnd(f"COUNT(*) FILTER (WHERE {LAG} > 300) * 100.0 / COUNT(*)", 2)} AS pct_delayed_5min
FROM dag_run WHERE {RUN_ROWS} AND start_date IS NOT NULL
GROUP BY dag_id HAVING AVG({LAG}) > 30 ORDER BY AVG({LAG}) DESC, dag_id LIMIT 30""")
def _(t: Get):
    return runs.scheduling_delay(t("dag_run"), **RUN)


def load_sql(table: str, counted: str, more: str, days: int = LOAD_DAYS) -> str:
    start, end = within("start_date", ORDERS_AS_OF, days), within("end_date", ORDERS_AS_OF, days)
    return f"""WITH points AS (
  SELECT start_date AS t FROM {table} WHERE {start} UNION SELECT end_date FROM {table} WHERE {end}),
spans AS (SELECT start_date AS s, end_date AS e FROM {table} WHERE {start} {counted}),
load AS (SELECT p.t, COUNT(x.s) AS n FROM points p LEFT JOIN spans x ON x.s <= p.t AND (x.e >= p.t OR x.e IS NULL)
         GROUP BY p.t)
SELECT {more} FROM load WHERE n > 0"""


@query("a09_run_concurrency", ["dag_run"], load_sql("dag_run", "", f"""MAX(n) AS max_concurrent_dags,
  {rnd("AVG(n)")} AS avg_concurrent_dags, {rnd("QUANTILE_CONT(n, 0.95)")} AS p95_concurrent_dags,
  {rnd("QUANTILE_CONT(n, 0.99)")} AS p99_concurrent_dags"""))
def _(t: Get):
    return runs.run_concurrency(t("dag_run"), as_of=ORDERS_AS_OF, analysis_days=LOAD_DAYS)


@query("a10_task_concurrency", ["task_instance"],
       load_sql("task_instance", "AND state IN ('running', 'queued')", f"""MAX(n) AS max_concurrent_tasks,
  {rnd("AVG(n)")} AS avg_concurrent_tasks, {rnd("QUANTILE_CONT(n, 0.95)")} AS p95_concurrent_tasks,
  {rnd("QUANTILE_CONT(n, 0.99)")} AS p99_concurrent_tasks, COUNT(*) AS sample_points"""))
def _(t: Get):
    return runs.task_concurrency(t("task_instance"), as_of=ORDERS_AS_OF, analysis_days=LOAD_DAYS)


@query("a11_catchup_backlog", ["dag_run"], f"""
SELECT dag_id, COUNT(*) AS queued_runs, MIN(execution_date) AS oldest_execution_date,
       MAX(execution_date) AS newest_execution_date,
       {rnd(sec("MAX(execution_date)", "MIN(execution_date)") + " / 3600")} AS backlog_span_hours,
       {rnd(sec(f"TIMESTAMP '{ORDERS_AS_OF}'", "MIN(execution_date)") + " / 3600")} AS oldest_run_age_hours
FROM dag_run WHERE state = 'queued'
GROUP BY dag_id ORDER BY queued_runs DESC, dag_id LIMIT 30""")
def _(t: Get):
    return runs.catchup_backlog(t("dag_run"), as_of=ORDERS_AS_OF)


_RUN_LOAD = load_sql("dag_run", "", "MAX(n) AS peak, AVG(n) AS average, QUANTILE_CONT(n, 0.95) AS p95")
_TASK_LOAD = load_sql("task_instance", "AND state IN ('running', 'queued')",
                       "MAX(n) AS peak, AVG(n) AS average, QUANTILE_CONT(n, 0.95) AS p95")


@query("a12_utilisation_vs_limit", ["dag_run", "task_instance"], f"""
SELECT scope, {big("capacity")} AS capacity, peak, {rnd("average")} AS average, {rnd("p95")} AS p95,
       {rnd("peak / capacity * 100", 2)} AS peak_percent, {rnd("average / capacity * 100", 2)} AS average_percent,
       CASE WHEN scope = 'runs' AND peak > capacity * 0.8 THEN 'Peak near limit'
            WHEN scope = 'runs' AND p95 > capacity * 0.6 THEN 'P95 high'
            WHEN scope = 'tasks' AND peak / capacity > 0.9 THEN 'Over 90%'
            WHEN scope = 'tasks' AND peak / capacity > 0.75 THEN 'Over 75%'
            WHEN scope = 'tasks' AND average / capacity < 0.3 THEN 'Under 30%' ELSE 'Normal' END AS label
FROM (SELECT 'runs' AS scope, 16 AS capacity, * FROM ({_RUN_LOAD})
      UNION ALL SELECT 'tasks', 32, * FROM ({_TASK_LOAD}))""")
def _(t: Get):
    load = {"as_of": ORDERS_AS_OF, "analysis_days": LOAD_DAYS}
    return runs.utilisation_vs_limit(
        runs.run_concurrency(t("dag_run"), **load), runs.task_concurrency(t("task_instance"), **load)
    )


DURATIONS = f"""d AS (SELECT dag_id, task_id, start_date, {RUNTIME} AS s FROM task_instance
  WHERE {TASK_ROWS} AND end_date IS NOT NULL AND state = 'success' AND {RUNTIME} > 0)"""
TRENDS = f"""{DURATIONS},
g AS (SELECT dag_id, task_id, COUNT(*) AS n, AVG(s) AS mean, STDDEV_SAMP(s) AS sd, MIN(s) AS lo, MAX(s) AS hi,
             QUANTILE_CONT(s, 0.5) AS p50, QUANTILE_CONT(s, 0.95) AS p95,
             AVG(s) FILTER (WHERE CAST(start_date AS DATE) >= {SPLIT}) AS recent,
             AVG(s) FILTER (WHERE CAST(start_date AS DATE) < {SPLIT}) AS old
      FROM d GROUP BY dag_id, task_id HAVING COUNT(*) >= 5),
trend AS (SELECT *, (recent - old) / NULLIF(old, 0) AS change FROM g WHERE recent IS NOT NULL AND old IS NOT NULL
          ORDER BY ABS((recent - old) / NULLIF(old, 0)) DESC NULLS LAST, dag_id, task_id LIMIT 30)"""


@query("b01_task_duration_trends", ["task_instance"], f"""WITH {TRENDS}
SELECT dag_id, task_id, n AS execution_count, {rnd("mean", 2)} AS avg_duration_seconds,
       {rnd("sd", 2)} AS stddev_duration_seconds, {rnd("lo", 2)} AS min_duration_seconds,
       {rnd("hi", 2)} AS max_duration_seconds, {rnd("p50", 2)} AS median_duration_seconds,
       {rnd("p95", 2)} AS p95_duration_seconds, {rnd("recent", 2)} AS recent_avg_duration,
       {rnd("old", 2)} AS old_avg_duration, {rnd("change * 100", 2)} AS duration_change_percent FROM trend""")
def _(t: Get):
    return tasks.task_duration_trends(t("task_instance"), **RUN)


@query("b02_duration_trend_status", ["task_instance"], f"""WITH {TRENDS}
SELECT dag_id, task_id, n AS execution_count, {rnd("mean", 2)} AS avg_duration_seconds,
       {rnd("change * 100", 2)} AS duration_change_percent,
       CASE WHEN {rnd("change * 100", 2)} > 50 THEN 'Degrading' WHEN {rnd("change * 100", 2)} > 20 THEN 'Slower'
            WHEN {rnd("change * 100", 2)} < -20 THEN 'Improved' ELSE 'Stable' END AS status FROM trend""")
def _(t: Get):
    return tasks.duration_trend_status(tasks.task_duration_trends(t("task_instance"), **RUN))


@query("b03_task_retry_patterns", ["task_instance"], f"""
SELECT dag_id, task_id, COUNT(*) AS total_attempts, COUNT(DISTINCT run_id) AS unique_runs,
       COUNT(*) FILTER (WHERE try_number > 1) AS retry_attempts, {big("MAX(try_number)")} AS max_retries,
       COUNT(*) FILTER (WHERE state = 'success') AS success_count,
       COUNT(*) FILTER (WHERE state = 'failed') AS failed_count,
       {rnd("COUNT(*) FILTER (WHERE try_number > 1) * 100.0 / COUNT(*)", 2)} AS retry_rate_percent,
       {rnd("COUNT(*) FILTER (WHERE state = 'failed') * 100.0 / COUNT(DISTINCT run_id)", 2)} AS failure_rate_percent
FROM task_instance WHERE {TASK_ROWS} GROUP BY dag_id, task_id HAVING COUNT(*) FILTER (WHERE try_number > 1) > 0
ORDER BY retry_attempts DESC, dag_id, task_id LIMIT 30""")
def _(t: Get):
    return tasks.task_retry_patterns(t("task_instance"), **RUN)


@query("b04_queue_depth", ["task_instance"], f"""WITH h AS (
  SELECT DATE_TRUNC('hour', start_date) AS hour, COUNT(*) FILTER (WHERE state = 'queued') AS q,
         COUNT(*) FILTER (WHERE state = 'running') AS r, COUNT(*) FILTER (WHERE state = 'scheduled') AS s
  FROM task_instance WHERE {TASK_ROWS} GROUP BY 1)
SELECT MAX(q) AS max_queued, {rnd("AVG(q)")} AS avg_queued, {rnd("QUANTILE_CONT(q, 0.95)")} AS p95_queued,
       MAX(r) AS max_running, {rnd("AVG(r)")} AS avg_running, MAX(s) AS max_scheduled, {rnd("AVG(s)")} AS avg_scheduled,
       COUNT(*) AS sample_hours FROM h""")
def _(t: Get):
    return tasks.queue_depth(t("task_instance"), **RUN)


@query("b05_executor_queue_lag", ["task_instance"], f"""
SELECT dag_id, task_id, COUNT(*) AS task_count, {rnd(f"AVG({WAIT})", 2)} AS avg_queue_lag_seconds,
       {rnd(f"MIN({WAIT})", 2)} AS min_queue_lag_seconds, {rnd(f"MAX({WAIT})", 2)} AS max_queue_lag_seconds,
       {rnd(f"QUANTILE_CONT({WAIT}, 0.95)", 2)} AS p95_queue_lag_seconds
FROM task_instance WHERE {TASK_ROWS} AND state IN ('success', 'failed', 'running') AND {WAIT} >= 0
GROUP BY dag_id, task_id HAVING COUNT(*) >= 5 ORDER BY AVG({WAIT}) DESC, dag_id, task_id LIMIT 30""")
def _(t: Get):
    return tasks.executor_queue_lag(t("task_instance"), **RUN)


@query("b06_queued_duration", ["task_instance"], f"""
SELECT dag_id, task_id, COUNT(*) AS task_count, {rnd(f"AVG({WAIT})", 2)} AS avg_queue_seconds,
       {rnd(f"QUANTILE_CONT({WAIT}, 0.5)", 2)} AS median_queue_seconds,
       {rnd(f"QUANTILE_CONT({WAIT}, 0.95)", 2)} AS p95_queue_seconds, {rnd(f"MAX({WAIT})", 2)} AS max_queue_seconds,
       COUNT(*) FILTER (WHERE {WAIT} > 60) AS queued_over_1min, COUNT(*) FILTER (WHERE {WAIT} > 300) AS queued_over_5min
FROM task_instance WHERE {within("queued_dttm", ORDERS_AS_OF, ORDERS_DAYS)} AND {WAIT} >= 0
GROUP BY dag_id, task_id HAVING AVG({WAIT}) > 10 ORDER BY AVG({WAIT}) DESC, dag_id, task_id LIMIT 30""")
def _(t: Get):
    return tasks.queued_duration(t("task_instance"), **RUN)


POOLS = f"""h AS (
  SELECT pool, DATE_TRUNC('hour', start_date) AS hour, COUNT(*) AS n, COUNT(*) FILTER (WHERE state = 'running') AS r
  FROM task_instance WHERE {TASK_ROWS} AND pool IS NOT NULL AND pool <> 'default_pool' GROUP BY 1, 2),
pools AS (
  SELECT h.pool, {big("s.slots")} AS pool_slots, COUNT(DISTINCT h.hour) AS active_hours, {rnd("AVG(n)", 2)} AS avg_tasks,
         MAX(n) AS max_tasks, {rnd("AVG(r)", 2)} AS avg_running, MAX(r) AS max_running,
         {rnd("AVG(r) / NULLIF(s.slots, 0) * 100", 2)} AS avg_utilization_percent,
         {rnd("MAX(r) / NULLIF(s.slots, 0) * 100", 2)} AS peak_utilization_percent
  FROM h LEFT JOIN slot_pool s ON h.pool = s.pool GROUP BY h.pool, s.slots)"""


@query("b07_pool_utilisation", ["task_instance", "slot_pool"], f"WITH {POOLS} SELECT * FROM pools")
def _(t: Get):
    return tasks.pool_utilisation(t("task_instance"), t("slot_pool"), **RUN)


@query("b07_pool_utilisation_status", ["task_instance", "slot_pool"], f"""WITH {POOLS}
SELECT pool, avg_utilization_percent, peak_utilization_percent,
       CASE WHEN COALESCE(peak_utilization_percent, 0) > 90 THEN 'Overutilized'
            WHEN COALESCE(avg_utilization_percent, 0) < 20 THEN 'Underutilized' ELSE 'Normal' END AS status FROM pools""")
def _(t: Get):
    return tasks.pool_utilisation_status(tasks.pool_utilisation(t("task_instance"), t("slot_pool"), **RUN))


@query("b08_zombie_tasks", ["task_instance"], f"""
SELECT dag_id, task_id, run_id, state, start_date,
       {rnd(sec(f"TIMESTAMP '{ORDERS_AS_OF}'", "start_date") + " / 3600")} AS hours_running, hostname,
       {big("pid")} AS pid
FROM task_instance WHERE state = 'running' AND start_date < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 6 HOUR
ORDER BY start_date, dag_id, task_id, run_id, hostname, pid LIMIT 50""")
def _(t: Get):
    return tasks.zombie_tasks(t("task_instance"), as_of=ORDERS_AS_OF)


@query("b09_execution_variance", ["task_instance"], f"""WITH {DURATIONS}
SELECT dag_id, task_id, COUNT(*) AS execution_count, {rnd("AVG(s)", 2)} AS avg_duration_seconds,
       {rnd("STDDEV_SAMP(s)", 2)} AS stddev_duration_seconds, {rnd("MIN(s)", 2)} AS min_duration_seconds,
       {rnd("MAX(s)", 2)} AS max_duration_seconds,
       {rnd("STDDEV_SAMP(s) / AVG(s) * 100", 2)} AS coefficient_of_variation,
       {rnd("(MAX(s) - MIN(s)) / AVG(s)", 2)} AS range_ratio
FROM d GROUP BY dag_id, task_id HAVING COUNT(*) >= 5 AND STDDEV_SAMP(s) IS NOT NULL
ORDER BY STDDEV_SAMP(s) / AVG(s) DESC, dag_id, task_id LIMIT 30""")
def _(t: Get):
    return tasks.execution_variance(t("task_instance"), **RUN)


@query("b10_sla_miss_patterns", ["sla_miss"], f"""
SELECT dag_id, task_id, COUNT(*) AS sla_miss_count, MAX("timestamp") AS last_sla_miss,
       MIN("timestamp") AS first_sla_miss, COUNT(DISTINCT CAST("timestamp" AS DATE)) AS days_with_misses,
       {rnd(f'AVG({sec(chr(34) + "timestamp" + chr(34), "execution_date")})')} AS avg_delay_seconds
FROM sla_miss WHERE {within('"timestamp"', EVENTS_AS_OF, EVENTS_DAYS)} GROUP BY dag_id, task_id
ORDER BY sla_miss_count DESC, dag_id, task_id LIMIT 30""")
def _(t: Get):
    return tasks.sla_miss_patterns(t("sla_miss"), **EVENT)
