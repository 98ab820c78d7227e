"""Snapshot, configuration, inventory and policy queries."""

from __future__ import annotations

from runscope.operators import config_audit, inventory, snapshots

from .q_documents import UNITS
from .register import ORDERS_AS_OF, Get, big, query, rnd, sec, uncut

NOW = f"TIMESTAMP '{ORDERS_AS_OF}'"


def _pretty(column: str) -> str:
    return f"(SELECT {UNITS} FROM (SELECT {column} AS s))"


FOOTPRINT = """f AS (SELECT *, total_size_bytes - table_size_bytes AS indexes_size_bytes FROM table_sizes
  WHERE schemaname = 'public' ORDER BY total_size_bytes DESC, tablename LIMIT 20)"""


@query("e01_storage_footprint", ["table_sizes"], f"""WITH {FOOTPRINT}
SELECT schemaname, tablename, {_pretty("total_size_bytes")} AS total_size, total_size_bytes,
       {_pretty("table_size_bytes")} AS table_size, table_size_bytes, {_pretty("indexes_size_bytes")} AS indexes_size,
       indexes_size_bytes FROM f""")
def _(t: Get):
    return snapshots.storage_footprint(t("table_sizes"))


@query("e01_storage_total", ["table_sizes"], f"""WITH {uncut(FOOTPRINT)}
SELECT {rnd("SUM(total_size_bytes) / 1073741824", 2)} AS total_gb,
       COUNT(*) FILTER (WHERE total_size_bytes > 1000000000) AS large_tables FROM f""")
def _(t: Get):
    return snapshots.storage_total(snapshots.storage_footprint(t("table_sizes"), limit=None))


@query("e02_index_usage", ["index_usage"], f"""
SELECT schemaname, tablename, indexname, index_scans, tuples_read, tuples_fetched,
       {_pretty("index_size_bytes")} AS index_size, index_size_bytes, index_scans = 0 AS is_unused,
       index_scans = 0 AND index_size_bytes > 10000000 AS is_large_unused
FROM (SELECT * FROM index_usage ORDER BY index_scans, index_size_bytes DESC, tablename, indexname LIMIT 30)""")
def _(t: Get):
    return snapshots.index_usage(t("index_usage"))


WAITS = f"""waits AS (
  SELECT a.pid, usename, application_name, state, query, wait_event_type, wait_event,
         {sec(NOW, "query_start")} AS query_duration, locktype, mode, granted
  FROM activity a JOIN locks l ON a.pid = l.pid WHERE a.state <> 'idle' AND NOT l.granted)"""


@query("e03_lock_waits", ["activity", "locks"], f"""WITH {WAITS}
SELECT * EXCLUDE (pid, query_duration), {big("pid")} AS pid, {rnd("query_duration")} AS query_duration FROM waits
ORDER BY query_duration DESC, pid, locktype, mode LIMIT 20""")
def _(t: Get):
    return snapshots.lock_waits(t("activity"), t("locks"), as_of=ORDERS_AS_OF)


@query("e03_lock_status", ["activity", "locks"], f"""WITH {WAITS}
SELECT COUNT(*) AS blocked_queries, CASE WHEN COUNT(*) > 5 THEN 'Critical' WHEN COUNT(*) > 0 THEN 'Warning'
       ELSE 'Normal' END AS status FROM waits""")
def _(t: Get):
    return snapshots.lock_status(snapshots.lock_waits(t("activity"), t("locks"), as_of=ORDERS_AS_OF, limit=None))


CONNECTIONS = f"""stats AS (
  SELECT COUNT(*) AS total_connections, COUNT(*) FILTER (WHERE state = 'active') AS active_connections,
         COUNT(*) FILTER (WHERE state = 'idle') AS idle_connections,
         COUNT(*) FILTER (WHERE state = 'idle in transaction') AS idle_in_transaction,
         COUNT(*) FILTER (WHERE wait_event_type IS NOT NULL) AS waiting_connections,
         {rnd(f"MAX({sec(NOW, 'backend_start')})")} AS max_connection_age_seconds,
         {rnd(f"AVG({sec(NOW, 'backend_start')})")} AS avg_connection_age_seconds FROM activity)"""


@query("e04_connection_stats", ["activity"], f"WITH {CONNECTIONS} SELECT * FROM stats")
def _(t: Get):
    return snapshots.connection_stats(t("activity"), as_of=ORDERS_AS_OF)


@query("e04_connection_status", ["activity"], f"""WITH {CONNECTIONS}
SELECT total_connections, {rnd("total_connections * 100.0 / 2000", 2)} AS pool_percent,
       CASE WHEN total_connections * 100.0 / 2000 > 90 THEN 'Critical'
            WHEN total_connections * 100.0 / 2000 > 75 THEN 'Warning' ELSE 'Normal' END AS pool_status,
       idle_in_transaction > 5 AS has_idle_transactions FROM stats""")
def _(t: Get):
    stats = snapshots.connection_stats(t("activity"), as_of=ORDERS_AS_OF)
    return snapshots.connection_status(stats, pool_size=500, max_overflow=1500)


# fixed values, written out once more for the twins: lowest and highest good value, labels and the level below
RANGES = [
    ("core", "parallelism", 10, "warning:Low", 100, "warning:High"),
    ("core", "dag_file_processor_timeout", 30, "warning:Too Low", 300, "warning:Too High"),
    ("scheduler", "dag_dir_list_interval", 30, "warning:Too Frequent", 300, "warning:Too Slow"),
    ("scheduler", "parsing_processes", 1, "error:Too Low", 8, "warning:High"),
    ("celery", "worker_concurrency", 4, "warning:Low", 32, "warning:High"),
    ("database", "sql_alchemy_pool_size", 5, "warning:Small", 50, "warning:Large"),
]


def _range(section: str, setting: str, low: int, below: str, high: int, above: str) -> str:
    n = "TRY_CAST(value AS BIGINT)"
    return (
        f"WHEN section = '{section}' AND setting = '{setting}' THEN CASE WHEN {n} IS NULL THEN 'error:Invalid' "
        f"WHEN {n} > {high} THEN '{above}' WHEN {n} < {low} THEN '{below}' ELSE 'ok:Good' END"
    )


STATUS = f"""judged AS (
  SELECT *, CASE WHEN value = 'NOT_SET' THEN 'info:Default'
    {" ".join(_range(*r) for r in RANGES)}
    WHEN section = 'core' AND setting = 'executor' AND NOT contains(lower(value), 'celery') THEN 'warning:Non-Celery'
    WHEN section = 'core' AND setting IN ('store_serialized_dags', 'compress_serialized_dags') THEN
      CASE WHEN lower(value) IN ('true', '1', 'yes') THEN 'ok:Enabled' ELSE 'warning:Disabled' END
    WHEN section = 'celery' AND setting IN ('broker_url', 'result_backend') THEN
      CASE WHEN contains(lower(value), 'redis') THEN 'ok:Redis' WHEN contains(lower(value), 'sqs') THEN 'ok:SQS'
           WHEN contains(lower(value), 'rabbitmq') THEN 'ok:RabbitMQ' ELSE 'info:Other' END
    ELSE 'ok:Set' END AS v FROM settings),
rated AS (SELECT * EXCLUDE (v), split_part(v, ':', 1) AS level, split_part(v, ':', 2) AS status FROM judged)"""


@query("c10_config_setting_status", ["settings"], f"WITH {STATUS} SELECT * FROM rated")
def _(t: Get):
    return config_audit.config_setting_status(t("settings"))


HIGH = """'executor', 'parallelism', 'max_active_tasks_per_dag', 'max_active_runs_per_dag', 'dagbag_import_timeout',
'dag_file_processor_timeout', 'store_serialized_dags', 'min_serialized_dag_update_interval',
'min_serialized_dag_fetch_interval', 'dag_dir_list_interval', 'min_file_process_interval', 'parsing_processes',
'worker_concurrency', 'broker_url', 'result_backend', 'sql_alchemy_pool_size', 'sql_alchemy_max_overflow'"""


@query("c11_config_impact", ["settings"], f"""
SELECT *, CASE WHEN setting IN ({HIGH}) THEN 'HIGH' ELSE 'MEDIUM' END AS impact FROM settings""")
def _(t: Get):
    return config_audit.config_impact(t("settings"))


# name, section, setting, default
NUMBERS = [
    ("file_timeout", "core", "dag_file_processor_timeout", 50),
    ("import_timeout", "core", "dagbag_import_timeout", 30),
    ("list_interval", "scheduler", "dag_dir_list_interval", 300),
    ("process_interval", "scheduler", "min_file_process_interval", 30),
    ("parallelism", "core", "parallelism", 32),
    ("dag_tasks", "core", "max_active_tasks_per_dag", 16),
    ("dag_runs", "core", "max_active_runs_per_dag", 16),
    ("worker_slots", "celery", "worker_concurrency", 16),
    ("pool_size", "database", "sql_alchemy_pool_size", 5),
    ("max_overflow", "database", "sql_alchemy_max_overflow", 10),
    ("parsers", "scheduler", "parsing_processes", 2),
    ("web_workers", "webserver", "workers", 4),
    ("cleanup_time", "core", "killed_task_cleanup_time", 60),
    ("update_interval", "core", "min_serialized_dag_update_interval", 30),
    ("fetch_interval", "core", "min_serialized_dag_fetch_interval", 10),
    ("create_per_loop", "scheduler", "max_dagruns_to_create_per_loop", 10),
    ("schedule_per_loop", "scheduler", "max_dagruns_per_loop_to_schedule", 20),
]


def _input(name: str, section: str, setting: str, default: int) -> str:
    value = f"MAX(value) FILTER (WHERE section = '{section}' AND setting = '{setting}')"
    return f"CASE WHEN {value} IS NULL THEN {default} ELSE TRY_CAST({value} AS BIGINT) END AS {name}"


INPUTS = f"""i AS (SELECT env, captured_at, {", ".join(_input(*n) for n in NUMBERS)},
    COALESCE(MAX(value) FILTER (WHERE section = 'core' AND setting = 'executor'), 'SequentialExecutor') AS executor,
    MAX(value) FILTER (WHERE section = 'core' AND setting = 'store_serialized_dags') AS store
  FROM settings GROUP BY env, captured_at)"""
READABLE = """pool_size IS NOT NULL AND max_overflow IS NOT NULL AND parallelism IS NOT NULL AND parsers IS NOT NULL
  AND web_workers IS NOT NULL AND worker_slots IS NOT NULL"""
EXECUTOR = "CASE WHEN regexp_matches(executor, 'Celery') THEN 2 WHEN regexp_matches(executor, 'Local|Kubernetes') THEN 1 ELSE 0 END"
WORST = f"((parsers + web_workers + {EXECUTOR} + 2) * (pool_size + max_overflow))"

# number, severity, rule, condition, message
RULES = [
    (1, "CRITICAL", "import_timeout_not_below_processor_timeout", "import_timeout >= file_timeout",
     "printf('dagbag_import_timeout %ds is not below dag_file_processor_timeout %ds', import_timeout, file_timeout)"),
    (2, "WARNING", "import_timeout_close_to_processor_timeout",
     "import_timeout < file_timeout AND import_timeout > file_timeout * 0.8",
     "printf('dagbag_import_timeout %ds is within 20 percent of dag_file_processor_timeout %ds', import_timeout, file_timeout)"),
    (3, "CRITICAL", "process_interval_above_list_interval", "process_interval > list_interval",
     "printf('min_file_process_interval %ds is above dag_dir_list_interval %ds', process_interval, list_interval)"),
    (4, "WARNING", "process_interval_equals_list_interval", "process_interval = list_interval",
     "printf('min_file_process_interval %ds equals dag_dir_list_interval %ds', process_interval, list_interval)"),
    (5, "NOTICE", "serialized_dags_off", "COALESCE(store NOT IN ('True', 'true', '1'), TRUE)",
     "'store_serialized_dags is not enabled'"),
    (6, "NOTICE", "parallelism_below_dag_tasks", "parallelism < dag_tasks AND dag_runs IS NOT NULL",
     "printf('parallelism %d is below max_active_tasks_per_dag %d', parallelism, dag_tasks)"),
    (7, "NOTICE", "parallelism_below_possible_tasks", "parallelism < dag_tasks * dag_runs",
     "printf('parallelism %d is below max_active_tasks_per_dag %d x max_active_runs_per_dag %d', parallelism, dag_tasks, dag_runs)"),
    (8, "NOTICE", "worker_concurrency_above_parallelism", "worker_slots > parallelism",
     "printf('worker_concurrency %d is above parallelism %d', worker_slots, parallelism)"),
    (9, "NOTICE", "worker_concurrency_very_high", "worker_slots > 32 AND parallelism IS NOT NULL",
     "printf('worker_concurrency %d is very high', worker_slots)"),
    (10, "NOTICE", "pool_very_small", f"pool_size < 5 AND {READABLE}", "printf('pool size %d is below 5', pool_size)"),
    (11, "NOTICE", "pool_small_for_parsers", f"pool_size < GREATEST(5, parsers + 3) AND {READABLE}",
     "printf('pool size %d is small for %d parsing processes', pool_size, parsers)"),
    (12, "NOTICE", "pool_capacity_small", f"pool_size + max_overflow < 10 AND {READABLE}",
     "printf('pool size %d plus overflow %d is below 10', pool_size, max_overflow)"),
    (13, "NOTICE", "worst_case_connections_high", f"{WORST} > 100 AND {READABLE}",
     f"printf('up to %d database connections in the worst case', {WORST})"),
    (14, "NOTICE", "pool_very_large", f"pool_size > 50 AND {READABLE}",
     f"printf('pool size %d per process is very large, %d connections in the worst case', pool_size, {WORST})"),
    (15, "NOTICE", "pool_small_for_celery", f"contains(executor, 'Celery') AND pool_size < 10 AND {READABLE}",
     "printf('pool size %d is small for a Celery executor', pool_size)"),
    (16, "NOTICE", "few_parsers", "parsers < 2", "printf('%d parsing processes are few', parsers)"),
    (17, "NOTICE", "many_parsers", "parsers > 8", "printf('%d parsing processes are many', parsers)"),
    (18, "NOTICE", "list_interval_short", "list_interval < 30",
     "printf('dag_dir_list_interval %ds scans very often', list_interval)"),
    (19, "NOTICE", "list_interval_long", "list_interval > 600",
     "printf('dag_dir_list_interval %ds finds new files late', list_interval)"),
    (20, "NOTICE", "cleanup_time_short", "cleanup_time < 30", "printf('killed_task_cleanup_time %ds is very short', cleanup_time)"),
    (21, "NOTICE", "cleanup_time_long", "cleanup_time > 300", "printf('killed_task_cleanup_time %ds is long', cleanup_time)"),
    (22, "NOTICE", "update_interval_above_list_interval", "update_interval > list_interval AND fetch_interval IS NOT NULL",
     "printf('min_serialized_dag_update_interval %ds is above dag_dir_list_interval %ds', update_interval, list_interval)"),
    (23, "NOTICE", "fetch_interval_not_below_update_interval", "fetch_interval >= update_interval AND list_interval IS NOT NULL",
     "printf('min_serialized_dag_fetch_interval %ds is not below min_serialized_dag_update_interval %ds', fetch_interval, update_interval)"),
    (24, "NOTICE", "creates_more_than_it_schedules", "create_per_loop > schedule_per_loop",
     "printf('max_dagruns_to_create_per_loop %d is above max_dagruns_per_loop_to_schedule %d', create_per_loop, schedule_per_loop)"),
]
BROKEN = " UNION ALL ".join(
    f"SELECT env, captured_at, {big(str(no))} AS rule_no, '{severity}' AS severity, '{rule}' AS rule, {message} AS message "
    f"FROM i WHERE {when}"
    for no, severity, rule, when, message in RULES
)


@query("c12_config_conflicts", ["settings"], f"WITH {INPUTS} {BROKEN}")
def _(t: Get):
    return config_audit.config_conflicts(t("settings"))


@query("c13_connection_budget", ["settings"], f"""WITH {INPUTS}
SELECT env, captured_at, parsers + 2 AS scheduler_connections, {big("web_workers")} AS webserver_connections,
       {big(EXECUTOR)} AS executor_connections, {big("3")} AS other_connections,
       {big(f"parsers + 2 + web_workers + 3 + {EXECUTOR}")} AS total_estimated, {big("pool_size + max_overflow")} AS pool_per_process,
       {big(f"parsers + web_workers + 2 + {EXECUTOR}")} AS processes, {big(WORST)} AS worst_case
FROM i WHERE {READABLE}""")
def _(t: Get):
    return config_audit.connection_budget(t("settings"))


# every audited setting by section
NAMES = {
    "core": """executor parallelism max_active_tasks_per_dag max_active_runs_per_dag dagbag_import_timeout
        dag_file_processor_timeout killed_task_cleanup_time dag_discovery_safe_mode store_dag_code store_serialized_dags
        compress_serialized_dags min_serialized_dag_update_interval min_serialized_dag_fetch_interval""",
    "scheduler": """dag_dir_list_interval min_file_process_interval catchup_by_default max_dagruns_to_create_per_loop
        max_dagruns_per_loop_to_schedule pool_metrics_interval orphaned_tasks_check_interval child_process_log_directory
        parsing_processes file_parsing_sort_mode use_row_level_locking max_tis_per_query""",
    "celery": """worker_concurrency broker_url result_backend flower_host flower_port default_queue sync pool
        worker_precheck task_track_started task_publish_retry worker_enable_remote_control""",
    "webserver": "workers worker_timeout worker_refresh_batch_size reload_on_plugin_change",
    "database": """sql_alchemy_pool_size sql_alchemy_max_overflow sql_alchemy_pool_recycle sql_alchemy_pool_pre_ping
        sql_alchemy_schema""",
}
LISTED = ", ".join(f"('{s}', '{n}')" for s, names in NAMES.items() for n in names.split())
MASKED = "CASE WHEN setting IN ('broker_url', 'result_backend') AND value <> 'NOT_SET' THEN '***MASKED***' ELSE value END"
HASHES = f"""names(section, setting) AS (VALUES {LISTED}),
snaps AS (SELECT DISTINCT env, captured_at FROM settings),
vals AS (SELECT env, captured_at, section, setting, {MASKED} AS value FROM settings),
lines AS (
  SELECT s.env, s.captured_at, n.section, n.setting, n.section || '.' || n.setting || '=' ||
         COALESCE(v.value, 'NOT_SET') AS line
  FROM snaps s CROSS JOIN names n LEFT JOIN vals v ON v.env = s.env AND v.captured_at = s.captured_at
       AND v.section = n.section AND v.setting = n.setting),
hashes AS (
  SELECT env, captured_at, md5(string_agg(line, chr(10) ORDER BY section, setting)) AS config_hash
  FROM lines GROUP BY env, captured_at)"""


@query("c14_config_change", ["settings"], f"""WITH {HASHES},
p AS (SELECT *, LAG(config_hash) OVER (PARTITION BY env ORDER BY captured_at) AS previous_hash FROM hashes)
SELECT *, COALESCE(previous_hash <> config_hash, FALSE) AS config_changed FROM p""")
def _(t: Get):
    return config_audit.config_change(t("settings"))


@query("c15_config_status_counts", ["settings"], f"""WITH {STATUS}
SELECT env, captured_at, CASE WHEN value <> 'NOT_SET' AND setting IN ('broker_url', 'result_backend') THEN 'Set'
       WHEN contains(status, 'Good') THEN 'Good' WHEN contains(status, 'Set') THEN 'Set'
       WHEN contains(status, 'Default') THEN 'Default' WHEN level = 'warning' THEN 'Warning' ELSE 'Error' END AS family,
       COUNT(*) AS settings FROM rated GROUP BY 1, 2, 3""")
def _(t: Get):
    return config_audit.config_status_counts(t("settings"))


@query("c16_mask_settings", ["settings"], f"SELECT env, captured_at, section, setting, {MASKED} AS value FROM settings")
def _(t: Get):
    return config_audit.mask_settings(t("settings"))


PY = "ends_with(path, '.py')"
SUMMARY = f"""s AS (
  SELECT COUNT(*) AS total_files, COUNT(*) FILTER (WHERE {PY}) AS python_files_count,
         COUNT(*) FILTER (WHERE NOT {PY}) AS non_python_files_count, {big("SUM(size_bytes)")} AS total_size_bytes,
         {big(f"COALESCE(SUM(size_bytes) FILTER (WHERE {PY}), 0)")} AS python_size_bytes,
         {big(f"COALESCE(SUM(size_bytes) FILTER (WHERE NOT {PY}), 0)")} AS non_python_size_bytes FROM file_inventory)"""


@query("h01_inventory_summary", ["file_inventory"], f"""WITH {SUMMARY}
SELECT *, {rnd("total_size_bytes / 1048576", 2)} AS total_size_mb, {rnd("python_size_bytes / 1048576", 2)}
  AS python_size_mb, {rnd("non_python_size_bytes / 1048576", 2)} AS non_python_size_mb, FALSE AS has_ignore_file,
  {big("0")} AS ignore_lines FROM s""")
def _(t: Get):
    return inventory.inventory_summary(t("file_inventory"))


@query("h02_extension_counts", ["file_inventory"], f"""
SELECT CASE WHEN contains(path, '.') THEN '.' || lower(split_part(path, '.', -1)) ELSE 'no_extension' END AS extension,
       COUNT(*) AS files FROM file_inventory WHERE NOT {PY} GROUP BY 1""")
def _(t: Get):
    return inventory.extension_counts(t("file_inventory"))


@query("h03_largest_files", ["file_inventory"], f"""
SELECT path, size_bytes, {rnd("size_bytes / 1048576", 2)} AS size_mb FROM file_inventory
ORDER BY size_bytes DESC, path LIMIT 10""")
def _(t: Get):
    return inventory.largest_files(t("file_inventory"))


@query("h04_inventory_flags", ["file_inventory"], f"""WITH {SUMMARY}
SELECT 'NO_IGNORE_FILE' AS flag UNION ALL SELECT 'NON_PYTHON_FILES' FROM s WHERE non_python_files_count > 0
UNION ALL SELECT 'LARGE_FOLDER' FROM s WHERE {rnd("total_size_bytes / 1048576", 2)} > 0.5
UNION ALL SELECT 'LARGE_NON_PYTHON' FROM s WHERE {rnd("non_python_size_bytes / 1048576", 2)} > 10""")
def _(t: Get):
    return inventory.inventory_flags(inventory.inventory_summary(t("file_inventory")), folder_mb=0.5)


@query("l01_dag_policy", ["dag_defs"], """
SELECT dag_id, schedule_interval, schedule_interval = '@once' AS is_rejected,
       schedule_interval <> '@once' AND len(tags) = 0 AS tags_defaulted,
       CASE WHEN schedule_interval <> '@once' AND len(tags) = 0 THEN 'default' ELSE array_to_string(tags, ',') END AS tags
FROM dag_defs""")
def _(t: Get):
    return inventory.dag_policy(t("dag_defs"))


@query("l01_task_policy", ["task_defs"], f"""
SELECT dag_id, task_id, {big("1")} AS retries, COALESCE(retries, 0) <> 1 AS retries_changed FROM task_defs""")
def _(t: Get):
    return inventory.task_policy(t("task_defs"))
