"""Configuration audit over a long table of settings: env, captured_at, section, setting, value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import first_label
from ..functions.scale import with_previous

SNAPSHOT = ["env", "captured_at"]
NOT_SET = "NOT_SET"
MASK = "***MASKED***"

# fixed values: the settings that bear on stability, by section
AUDITED = {
    "core": [
        "executor",
        "parallelism",
        "max_active_tasks_per_dag",
        "max_active_runs_per_dag",
        "dagbag_import_timeout",
        "dag_file_processor_timeout",
        "killed_task_cleanup_time",
        "dag_discovery_safe_mode",
        "store_dag_code",
        "store_serialized_dags",
        "compress_serialized_dags",
        "min_serialized_dag_update_interval",
        "min_serialized_dag_fetch_interval",
    ],
    "scheduler": [
        "dag_dir_list_interval",
        "min_file_process_interval",
        "catchup_by_default",
        "max_dagruns_to_create_per_loop",
        "max_dagruns_per_loop_to_schedule",
        "pool_metrics_interval",
        "orphaned_tasks_check_interval",
        "child_process_log_directory",
        "parsing_processes",
        "file_parsing_sort_mode",
        "use_row_level_locking",
        "max_tis_per_query",
    ],
    "celery": [
        "worker_concurrency",
        "broker_url",
        "result_backend",
        "flower_host",
        "flower_port",
        "default_queue",
        "sync",
        "pool",
        "worker_precheck",
        "task_track_started",
        "task_publish_retry",
        "worker_enable_remote_control",
    ],
    "webserver": ["workers", "worker_timeout", "worker_refresh_batch_size", "reload_on_plugin_change"],
    "database": [
        "sql_alchemy_pool_size",
        "sql_alchemy_max_overflow",
        "sql_alchemy_pool_recycle",
        "sql_alchemy_pool_pre_ping",
        "sql_alchemy_schema",
    ],
}

# fixed values: settings of high impact; all others are medium
HIGH_IMPACT = [
    "executor",
    "parallelism",
    "max_active_tasks_per_dag",
    "max_active_runs_per_dag",
    "dagbag_import_timeout",
    "dag_file_processor_timeout",
    "store_serialized_dags",
    "min_serialized_dag_update_interval",
    "min_serialized_dag_fetch_interval",
    "dag_dir_list_interval",
    "min_file_process_interval",
    "parsing_processes",
    "worker_concurrency",
    "broker_url",
    "result_backend",
    "sql_alchemy_pool_size",
    "sql_alchemy_max_overflow",
]

# fixed values: settings never shown or hashed in the clear
SENSITIVE = ["broker_url", "result_backend"]

# fixed values: (section, setting) -> lowest good value, label and level below it; highest good value, label above it
NUMERIC_RANGES = {
    ("core", "parallelism"): (10, "Low", "warning", 100, "High"),
    ("core", "dag_file_processor_timeout"): (30, "Too Low", "warning", 300, "Too High"),
    ("scheduler", "dag_dir_list_interval"): (30, "Too Frequent", "warning", 300, "Too Slow"),
    ("scheduler", "parsing_processes"): (1, "Too Low", "error", 8, "High"),
    ("celery", "worker_concurrency"): (4, "Low", "warning", 32, "High"),
    ("database", "sql_alchemy_pool_size"): (5, "Small", "warning", 50, "Large"),
}

# fixed values: status families in the order they are tested
FAMILIES = ["Good", "Set", "Default", "Warning", "Error"]


def config_setting_status(settings: DataFrame) -> DataFrame:
    """Adds ``status`` and ``level`` (ok, info, warning, error) to each setting."""
    section, setting, value = F.col("section"), F.col("setting"), F.col("value")
    number = value.try_cast("bigint")

    def verdict(level: str, status: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(status).alias("status"))

    result = F.when(value == NOT_SET, verdict("info", "Default"))
    for (of_section, of_setting), (low, low_label, low_level, high, high_label) in NUMERIC_RANGES.items():
        judged = (
            F.when(number.isNull(), verdict("error", "Invalid"))
            .when(number > high, verdict("warning", high_label))
            .when(number < low, verdict(low_level, low_label))
            .otherwise(verdict("ok", "Good"))
        )
        result = result.when((section == of_section) & (setting == of_setting), judged)
    lower = F.lower(value)
    is_switch = (section == "core") & setting.isin("store_serialized_dags", "compress_serialized_dags")
    result = (
        result.when((section == "core") & (setting == "executor") & ~lower.contains("celery"), verdict("warning", "Non-Celery"))
        .when(is_switch & lower.isin("true", "1", "yes"), verdict("ok", "Enabled"))
        .when(is_switch, verdict("warning", "Disabled"))
    )
    is_backend = (section == "celery") & setting.isin(*SENSITIVE)
    for marker, label in (("redis", "Redis"), ("sqs", "SQS"), ("rabbitmq", "RabbitMQ")):
        result = result.when(is_backend & lower.contains(marker), verdict("ok", label))
    result = result.when(is_backend, verdict("info", "Other")).otherwise(verdict("ok", "Set"))
    return settings.withColumn("_v", result).select(
        *settings.columns, F.col("_v.level").alias("level"), F.col("_v.status").alias("status")
    )


def config_impact(settings: DataFrame) -> DataFrame:
    """Adds ``impact``."""
    return settings.withColumn(
        "impact", F.when(F.col("setting").isin(*HIGH_IMPACT), F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    )


def mask_settings(settings: DataFrame) -> DataFrame:
    """Hides the values of sensitive settings that are set."""
    hide = F.col("setting").isin(*SENSITIVE) & (F.col("value") != NOT_SET)
    return settings.withColumn("value", F.when(hide, F.lit(MASK)).otherwise(F.col("value")))


def config_status_counts(settings: DataFrame) -> DataFrame:
    """Settings per snapshot and status family.

    Sensitive settings that are set count as Set. Labels outside Good, Set, Default and the warnings count as Error,
    the switches' Enabled among them.
    """
    status = F.col("status")
    family = first_label(
        ((F.col("value") != NOT_SET) & F.col("setting").isin(*SENSITIVE), "Set"),
        (status.contains("Good"), "Good"),
        (status.contains("Set"), "Set"),
        (status.contains("Default"), "Default"),
        (F.col("level") == "warning", "Warning"),
        otherwise="Error",
    )
    return (
        config_setting_status(settings)
        .groupBy(*SNAPSHOT, family.alias("family"))
        .agg(F.count(F.lit(1)).alias("settings"))
    )


def _value(section: str, setting: str, alias: str) -> Column:
    return F.expr(f"max(CASE WHEN section = '{section}' AND setting = '{setting}' THEN value END)").alias(alias)


# fixed values: numeric settings the cross-setting rules read: name -> (section, setting, default)
RULE_INPUTS = {
    "file_timeout": ("core", "dag_file_processor_timeout", 50),
    "import_timeout": ("core", "dagbag_import_timeout", 30),
    "list_interval": ("scheduler", "dag_dir_list_interval", 300),
    "process_interval": ("scheduler", "min_file_process_interval", 30),
    "parallelism": ("core", "parallelism", 32),
    "dag_tasks": ("core", "max_active_tasks_per_dag", 16),
    "dag_runs": ("core", "max_active_runs_per_dag", 16),
    "worker_slots": ("celery", "worker_concurrency", 16),
    "pool_size": ("database", "sql_alchemy_pool_size", 5),
    "max_overflow": ("database", "sql_alchemy_max_overflow", 10),
    "parsers": ("scheduler", "parsing_processes", 2),
    "web_workers": ("webserver", "workers", 4),
    "cleanup_time": ("core", "killed_task_cleanup_time", 60),
    "update_interval": ("core", "min_serialized_dag_update_interval", 30),
    "fetch_interval": ("core", "min_serialized_dag_fetch_interval", 10),
    "create_per_loop": ("scheduler", "max_dagruns_to_create_per_loop", 10),
    "schedule_per_loop": ("scheduler", "max_dagruns_per_loop_to_schedule", 20),
}


def rule_inputs(settings: DataFrame) -> DataFrame:
    """One row per snapshot: missing settings take their default, values that are no whole number become null."""
    wide = settings.groupBy(*SNAPSHOT).agg(
        *[_value(section, setting, name) for name, (section, setting, _) in RULE_INPUTS.items()],
        _value("core", "executor", "executor"),
        _value("core", "store_serialized_dags", "store_serialized"),
    )
    numbers = [
        f"CASE WHEN {name} IS NULL THEN {default}L ELSE try_cast({name} AS BIGINT) END AS {name}"
        for name, (_, _, default) in RULE_INPUTS.items()
    ]
    return wide.selectExpr(
        *SNAPSHOT, *numbers, "coalesce(executor, 'SequentialExecutor') AS executor", "store_serialized"
    )


# connections each snapshot may open, over the columns of ``rule_inputs``
EXECUTOR_CONNECTIONS = (
    "CASE WHEN contains(executor, 'Celery') THEN 2 "
    "WHEN contains(executor, 'Local') OR contains(executor, 'Kubernetes') THEN 1 ELSE 0 END"
)
PROCESSES = f"(parsers + web_workers + {EXECUTOR_CONNECTIONS} + 2)"
WORST_CASE = f"{PROCESSES} * (pool_size + max_overflow)"
CONNECTIONS = {
    "scheduler_connections": "parsers + 2",
    "webserver_connections": "web_workers",
    "executor_connections": EXECUTOR_CONNECTIONS,
    "other_connections": "3",
    "total_estimated": f"parsers + 2 + web_workers + {EXECUTOR_CONNECTIONS} + 3",
    "pool_per_process": "pool_size + max_overflow",
    "processes": PROCESSES,
    "worst_case": WORST_CASE,
}
BUDGET_INPUTS = ["pool_size", "max_overflow", "parallelism", "parsers", "web_workers", "worker_slots"]


def connection_budget(settings: DataFrame) -> DataFrame:
    """Estimated and worst-case database connections per snapshot; snapshots with unreadable numbers are left out."""
    return (
        rule_inputs(settings)
        .where(_all_set(BUDGET_INPUTS))
        .selectExpr(*SNAPSHOT, *[f"CAST({value} AS BIGINT) AS {name}" for name, value in CONNECTIONS.items()])
    )


def _all_set(names: list[str]) -> str:
    return " AND ".join(f"{name} IS NOT NULL" for name in names) or "TRUE"


@dataclass(frozen=True)
class ConflictRule:
    """``when`` and ``args`` are SQL over ``rule_inputs``; all of ``reads`` must be numbers for the rule to apply."""

    severity: str
    name: str
    reads: list[str]
    when: str
    message: str
    args: list[str]


_TIMEOUTS = ["file_timeout", "import_timeout"]
_INTERVALS = ["list_interval", "process_interval"]
_TASK_LIMITS = ["parallelism", "dag_tasks", "dag_runs"]
_WORKERS = ["worker_slots", "parallelism"]
_SERIALIZATION = ["update_interval", "fetch_interval", "list_interval"]

CONFLICT_RULES = [
    ConflictRule(
        "CRITICAL", "import_timeout_not_below_processor_timeout", _TIMEOUTS, "import_timeout >= file_timeout",
        "dagbag_import_timeout %ds is not below dag_file_processor_timeout %ds", ["import_timeout", "file_timeout"],
    ),
    ConflictRule(
        "WARNING", "import_timeout_close_to_processor_timeout", _TIMEOUTS,
        "import_timeout < file_timeout AND import_timeout > file_timeout * 0.8D",
        "dagbag_import_timeout %ds is within 20 percent of dag_file_processor_timeout %ds",
        ["import_timeout", "file_timeout"],
    ),
    ConflictRule(
        "CRITICAL", "process_interval_above_list_interval", _INTERVALS, "process_interval > list_interval",
        "min_file_process_interval %ds is above dag_dir_list_interval %ds", ["process_interval", "list_interval"],
    ),
    ConflictRule(
        "WARNING", "process_interval_equals_list_interval", _INTERVALS, "process_interval = list_interval",
        "min_file_process_interval %ds equals dag_dir_list_interval %ds", ["process_interval", "list_interval"],
    ),
    ConflictRule(
        "NOTICE", "serialized_dags_off", [], "coalesce(store_serialized NOT IN ('True', 'true', '1'), TRUE)",
        "store_serialized_dags is not enabled", [],
    ),
    ConflictRule(
        "NOTICE", "parallelism_below_dag_tasks", _TASK_LIMITS, "parallelism < dag_tasks",
        "parallelism %d is below max_active_tasks_per_dag %d", ["parallelism", "dag_tasks"],
    ),
    ConflictRule(
        "NOTICE", "parallelism_below_possible_tasks", _TASK_LIMITS, "parallelism < dag_tasks * dag_runs",
        "parallelism %d is below max_active_tasks_per_dag %d x max_active_runs_per_dag %d", _TASK_LIMITS,
    ),
    ConflictRule(
        "NOTICE", "worker_concurrency_above_parallelism", _WORKERS, "worker_slots > parallelism",
        "worker_concurrency %d is above parallelism %d", _WORKERS,
    ),
    ConflictRule(
        "NOTICE", "worker_concurrency_very_high", _WORKERS, "worker_slots > 32",
        "worker_concurrency %d is very high", ["worker_slots"],
    ),
    ConflictRule(
        "NOTICE", "pool_very_small", BUDGET_INPUTS, "pool_size < 5", "pool size %d is below 5", ["pool_size"],
    ),
    ConflictRule(
        "NOTICE", "pool_small_for_parsers", BUDGET_INPUTS, "pool_size < greatest(5, parsers + 3)",
        "pool size %d is small for %d parsing processes", ["pool_size", "parsers"],
    ),
    ConflictRule(
        "NOTICE", "pool_capacity_small", BUDGET_INPUTS, "pool_size + max_overflow < 10",
        "pool size %d plus overflow %d is below 10", ["pool_size", "max_overflow"],
    ),
    ConflictRule(
        "NOTICE", "worst_case_connections_high", BUDGET_INPUTS, f"{WORST_CASE} > 100",
        "up to %d database connections in the worst case", [WORST_CASE],
    ),
    ConflictRule(
        "NOTICE", "pool_very_large", BUDGET_INPUTS, "pool_size > 50",
        "pool size %d per process is very large, %d connections in the worst case", ["pool_size", WORST_CASE],
    ),
    ConflictRule(
        "NOTICE", "pool_small_for_celery", BUDGET_INPUTS, "contains(executor, 'Celery') AND pool_size < 10",
        "pool size %d is small for a Celery executor", ["pool_size"],
    ),
    ConflictRule("NOTICE", "few_parsers", ["parsers"], "parsers < 2", "%d parsing processes are few", ["parsers"]),
    ConflictRule("NOTICE", "many_parsers", ["parsers"], "parsers > 8", "%d parsing processes are many", ["parsers"]),
    ConflictRule(
        "NOTICE", "list_interval_short", ["list_interval"], "list_interval < 30",
        "dag_dir_list_interval %ds scans very often", ["list_interval"],
    ),
    ConflictRule(
        "NOTICE", "list_interval_long", ["list_interval"], "list_interval > 600",
        "dag_dir_list_interval %ds finds new files late", ["list_interval"],
    ),
    ConflictRule(
        "NOTICE", "cleanup_time_short", ["cleanup_time"], "cleanup_time < 30",
        "killed_task_cleanup_time %ds is very short", ["cleanup_time"],
    ),
    ConflictRule(
        "NOTICE", "cleanup_time_long", ["cleanup_time"], "cleanup_time > 300",
        "killed_task_cleanup_time %ds is long", ["cleanup_time"],
    ),
    ConflictRule(
        "NOTICE", "update_interval_above_list_interval", _SERIALIZATION, "update_interval > list_interval",
        "min_serialized_dag_update_interval %ds is above dag_dir_list_interval %ds", ["update_interval", "list_interval"],
    ),
    ConflictRule(
        "NOTICE", "fetch_interval_not_below_update_interval", _SERIALIZATION, "fetch_interval >= update_interval",
        "min_serialized_dag_fetch_interval %ds is not below min_serialized_dag_update_interval %ds",
        ["fetch_interval", "update_interval"],
    ),
    ConflictRule(
        "NOTICE", "creates_more_than_it_schedules", ["create_per_loop", "schedule_per_loop"],
        "create_per_loop > schedule_per_loop",
        "max_dagruns_to_create_per_loop %d is above max_dagruns_per_loop_to_schedule %d",
        ["create_per_loop", "schedule_per_loop"],
    ),
]


def config_conflicts(settings: DataFrame) -> DataFrame:
    """Cross-setting conflicts: one row per snapshot and broken rule.

    A rule is skipped when any number its group reads is not one. Severity is CRITICAL, WARNING or NOTICE.
    """
    broken = []
    for number, rule in enumerate(CONFLICT_RULES, start=1):
        message = f"format_string({', '.join([repr(rule.message), *rule.args])})"
        row = f"'rule_no', {number}, 'severity', '{rule.severity}', 'rule', '{rule.name}', 'message', {message}"
        broken.append(f"CASE WHEN {_all_set(rule.reads)} AND {rule.when} THEN named_struct({row}) END")
    return rule_inputs(settings).selectExpr(*SNAPSHOT, f"inline(array_compact(array({', '.join(broken)})))")


def config_fingerprint(settings: DataFrame) -> DataFrame:
    """md5 per snapshot over the audited settings, sensitive ones masked, in name order (unset ones as NOT_SET)."""
    names = sorted((section, setting) for section, items in AUDITED.items() for setting in items)
    masked = mask_settings(settings)
    wide = masked.groupBy(*SNAPSHOT).agg(*[_value(s, n, f"{s}__{n}") for s, n in names])
    lines = [F.expr(f"concat('{s}.{n}=', coalesce({s}__{n}, '{NOT_SET}'))") for s, n in names]
    return wide.select(*SNAPSHOT, F.md5(F.concat_ws("\n", *lines)).alias("config_hash"))


def config_change(settings: DataFrame) -> DataFrame:
    """Fingerprints with the one before of the same environment; the first one counts as unchanged."""
    hashes = with_previous(config_fingerprint(settings), "env", "captured_at", "config_hash", "previous_hash")
    changed = F.coalesce(F.col("previous_hash") != F.col("config_hash"), F.lit(False))
    return hashes.withColumn("config_changed", changed)
