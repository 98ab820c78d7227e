"""Snapshots, configuration, inventory and policy."""

from __future__ import annotations

import pytest

from runscope.operators import config_audit, inventory, snapshots

from .conftest import as_dicts


def settings(make, values: dict[str, str], env="e", at="2024-01-01 00:00:00"):
    rows = [{"env": env, "captured_at": at, "section": k.split(".")[0], "setting": k.split(".")[1], "value": v} for k, v in values.items()]
    return make("settings", rows)


@pytest.mark.parametrize(
    ("name", "value", "level", "status"),
    [
        ("core.parallelism", "NOT_SET", "info", "Default"),
        ("core.parallelism", "abc", "error", "Invalid"),
        ("core.parallelism", "9", "warning", "Low"),
        ("core.parallelism", "10", "ok", "Good"),
        ("core.parallelism", "100", "ok", "Good"),
        ("core.parallelism", "101", "warning", "High"),
        ("core.executor", "LocalExecutor", "warning", "Non-Celery"),
        ("core.executor", "CeleryExecutor", "ok", "Set"),
        ("core.dag_file_processor_timeout", "301", "warning", "Too High"),
        ("core.store_serialized_dags", "Yes", "ok", "Enabled"),
        ("core.compress_serialized_dags", "off", "warning", "Disabled"),
        ("scheduler.dag_dir_list_interval", "29", "warning", "Too Frequent"),
        ("scheduler.parsing_processes", "0", "error", "Too Low"),
        ("scheduler.parsing_processes", "9", "warning", "High"),
        ("celery.worker_concurrency", "33", "warning", "High"),
        ("celery.broker_url", "REDIS://x", "ok", "Redis"),
        ("celery.result_backend", "db+mysql", "info", "Other"),
        ("database.sql_alchemy_pool_size", "4", "warning", "Small"),
        ("webserver.workers", "4", "ok", "Set"),
    ],
)
def test_setting_status(make, name, value, level, status):
    row = config_audit.config_setting_status(settings(make, {name: value})).first()
    assert (row["level"], row["status"]) == (level, status)


def broken(make, **values) -> set[str]:
    named = {k.replace("__", "."): str(v) for k, v in values.items()}
    named.setdefault("core.store_serialized_dags", "True")
    named.setdefault("core.max_active_runs_per_dag", "2")
    return {r["rule"] for r in config_audit.config_conflicts(settings(make, named)).collect()}


NOTHING: set[str] = set()
BUDGET = {"worst_case_connections_high"}  # 2 + 4 + 2 processes x 15 connections by default


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({}, BUDGET),
        ({"core__dagbag_import_timeout": 50}, BUDGET | {"import_timeout_not_below_processor_timeout"}),
        ({"core__dagbag_import_timeout": 41}, BUDGET | {"import_timeout_close_to_processor_timeout"}),
        ({"core__dagbag_import_timeout": 40}, BUDGET),
        ({"core__dagbag_import_timeout": "NOT_SET"}, BUDGET),
        ({"scheduler__min_file_process_interval": 300}, BUDGET | {"process_interval_equals_list_interval"}),
        ({"scheduler__min_file_process_interval": 301}, BUDGET | {"process_interval_above_list_interval"}),
        ({"core__store_serialized_dags": "no"}, BUDGET | {"serialized_dags_off"}),
        ({"core__parallelism": 31}, BUDGET | {"parallelism_below_possible_tasks"}),
        ({"core__parallelism": 15}, BUDGET | {"parallelism_below_dag_tasks", "parallelism_below_possible_tasks", "worker_concurrency_above_parallelism"}),
        ({"core__parallelism": "abc", "celery__worker_concurrency": 99, "database__sql_alchemy_pool_size": 1}, NOTHING),
        ({"celery__worker_concurrency": 33}, BUDGET | {"worker_concurrency_above_parallelism", "worker_concurrency_very_high"}),
        ({"database__sql_alchemy_pool_size": 4, "database__sql_alchemy_max_overflow": 5}, {"pool_very_small", "pool_small_for_parsers", "pool_capacity_small"}),
        ({"database__sql_alchemy_pool_size": 51}, BUDGET | {"pool_very_large"}),
        ({"core__executor": "CeleryExecutor"}, BUDGET | {"pool_small_for_celery"}),
        ({"scheduler__parsing_processes": 1}, BUDGET | {"few_parsers"}),
        ({"scheduler__parsing_processes": 9}, BUDGET | {"many_parsers", "pool_small_for_parsers"}),
        ({"scheduler__dag_dir_list_interval": 29, "scheduler__min_file_process_interval": 1, "core__min_serialized_dag_update_interval": 29}, BUDGET | {"list_interval_short"}),
        ({"scheduler__dag_dir_list_interval": 601}, BUDGET | {"list_interval_long"}),
        ({"core__killed_task_cleanup_time": 29}, BUDGET | {"cleanup_time_short"}),
        ({"core__killed_task_cleanup_time": 301}, BUDGET | {"cleanup_time_long"}),
        ({"core__min_serialized_dag_update_interval": 301}, BUDGET | {"update_interval_above_list_interval"}),
        ({"core__min_serialized_dag_fetch_interval": 30}, BUDGET | {"fetch_interval_not_below_update_interval"}),
        ({"scheduler__max_dagruns_to_create_per_loop": 21}, BUDGET | {"creates_more_than_it_schedules"}),
        ({"database__sql_alchemy_pool_size": 2, "database__sql_alchemy_max_overflow": 10, "webserver__workers": 4}, {"pool_very_small", "pool_small_for_parsers"}),
    ],
)
def test_conflict_rules(make, values, expected):
    assert broken(make, **values) == expected


def test_connection_budget(make):
    row = config_audit.connection_budget(settings(make, {"core.executor": "CeleryExecutor", "webserver.workers": "2"})).first()
    assert (row["total_estimated"], row["processes"], row["worst_case"]) == (11, 8, 120)
    assert config_audit.connection_budget(settings(make, {"core.parallelism": "x"})).count() == 0


def test_fingerprint(make):
    a = settings(make, {"core.parallelism": "1", "celery.broker_url": "redis://a"})
    secret = settings(make, {"celery.broker_url": "redis://b", "core.parallelism": "1"}, at="2024-01-02 00:00:00")
    changed = settings(make, {"celery.broker_url": "redis://b", "core.parallelism": "2"}, at="2024-01-03 00:00:00")
    explicit = settings(make, {"celery.broker_url": "x", "core.parallelism": "2", "core.executor": "NOT_SET"}, at="2024-01-04 00:00:00")
    log = config_audit.config_change(a.union(secret).union(changed).union(explicit)).orderBy("captured_at").collect()
    assert [r["config_changed"] for r in log] == [False, False, True, False]
    assert log[0]["previous_hash"] is None and log[1]["previous_hash"] == log[0]["config_hash"]
    assert [r["value"] for r in config_audit.mask_settings(a).orderBy("setting").collect()] == ["***MASKED***", "1"]
    unset = settings(make, {"celery.broker_url": "NOT_SET"})
    assert config_audit.mask_settings(unset).first()["value"] == "NOT_SET"


def test_status_counts(make):
    values = {"core.parallelism": "50", "celery.broker_url": "amqp", "core.executor": "NOT_SET", "core.store_serialized_dags": "true", "scheduler.parsing_processes": "9", "webserver.workers": "4"}
    got = {r["family"]: r["settings"] for r in config_audit.config_status_counts(settings(make, values)).collect()}
    assert got == {"Good": 1, "Set": 2, "Default": 1, "Error": 1, "Warning": 1}


def test_lock_waits_broadcast_neither_side(spark):
    """Small files may hold many rows: what waits and what is waited for stay on the executors."""
    fields = "usename application_name query wait_event_type wait_event".split()
    activity = spark.range(1000).selectExpr("id AS pid", "'active' AS state", "timestamp_seconds(id) AS query_start", *[f"'' AS {f}" for f in fields])
    locks = spark.range(1000).selectExpr("id AS pid", "'x' AS locktype", "'m' AS mode", "id % 5 <> 0 AS granted")
    waits = snapshots.lock_waits(activity, locks, as_of="2024-01-01 00:01:00", limit=None)
    assert "BroadcastHashJoin" not in waits._jdf.queryExecution().sparkPlan().toString()
    assert waits.count() == 200


def test_locks_and_connections(make):
    activity = make("activity", [
        {"pid": 1, "state": "active", "query_start": "2024-01-01 00:00:00", "backend_start": "2024-01-01 00:00:00"},
        {"pid": 2, "state": "idle", "wait_event_type": "Lock", "backend_start": "2024-01-01 00:00:30"},
        {"pid": 3, "state": "idle in transaction"},
    ])
    locks = make("locks", [{"pid": 1, "locktype": "x", "mode": "m", "granted": g} for g in (True, False, None)] + [{"pid": 2, "granted": False}])
    waits = snapshots.lock_waits(activity, locks, as_of="2024-01-01 00:01:00")
    assert [(r["pid"], r["query_duration"]) for r in waits.collect()] == [(1, 60.0)]
    assert snapshots.lock_status(waits).first()["status"] == "Warning"
    stats = snapshots.connection_stats(activity, as_of="2024-01-01 00:01:00")
    row = stats.first()
    assert (row["waiting_connections"], row["max_connection_age_seconds"], row["avg_connection_age_seconds"]) == (1, 60.0, 45.0)
    assert snapshots.connection_status(stats, pool_size=3, max_overflow=0).first()["pool_status"] == "Critical"


def test_indexes_and_sizes(make):
    index = make("index_usage", [{"schemaname": "public", "tablename": "t", "indexname": n, "index_scans": s, "index_size_bytes": b} for n, s, b in (("a", 0, 10_000_000), ("b", 0, 10_000_001), ("c", 1, 5))])
    got = [(r["indexname"], r["is_unused"], r["is_large_unused"]) for r in snapshots.index_usage(index).collect()]
    assert got == [("b", True, True), ("a", True, False), ("c", False, False)]
    sizes = make("table_sizes", [{"schemaname": "public", "tablename": "t", "total_size_bytes": 1_000_000_001, "table_size_bytes": 1}, {"schemaname": "other", "tablename": "u", "total_size_bytes": 5, "table_size_bytes": 1}])
    footprint = snapshots.storage_footprint(sizes)
    assert [(r["total_size"], r["indexes_size_bytes"]) for r in footprint.collect()] == [("954 MB", 1_000_000_000)]
    assert tuple(snapshots.storage_total(footprint).first()) == (0.93, 1)


def test_inventory(spark, make):
    names = ["a.py", "b/c.SQL", "b/data.csv", ".hidden", "b/.git/x", "b/__pycache__/y.pyc", "noext"]
    files = make("file_inventory", [{"path": p, "size_bytes": 1_048_576} for p in names])
    row = inventory.inventory_summary(files).first()
    assert (row["total_files"], row["python_files_count"], row["non_python_size_mb"], row["has_ignore_file"]) == (4, 1, 3.0, False)
    assert as_dicts(inventory.extension_counts(files)) == [{"extension": e, "files": 1} for e in (".csv", ".sql", "no_extension")]
    assert [r["flag"] for r in inventory.inventory_flags(inventory.inventory_summary(files)).collect()] == ["NO_IGNORE_FILE", "NON_PYTHON_FILES"]
    ignore = spark.createDataFrame([("a\nb\n\n",)], "value string")
    row = inventory.inventory_summary(files, ignore_file=ignore).first()
    assert (row["has_ignore_file"], row["ignore_lines"]) == (True, 2)


def test_policies(make):
    defs = make("dag_defs", [{"dag_id": "a", "schedule_interval": "@once", "tags": []}, {"dag_id": "b", "tags": None}, {"dag_id": "c", "tags": ["x"]}])
    got = {r["dag_id"]: (r["is_rejected"], r["tags_defaulted"], r["tags"]) for r in inventory.dag_policy(defs).collect()}
    assert got == {"a": (True, False, []), "b": (False, True, ["default"]), "c": (False, False, ["x"])}
    tasks = make("task_defs", [{"task_id": str(i), "retries": r} for i, r in enumerate((None, 0, 1))])
    assert [(r["retries"], r["retries_changed"]) for r in inventory.task_policy(tasks).orderBy("task_id").collect()] == [(1, True), (1, True), (1, False)]
