"""Explicit schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: columns the operators read, per table
SCHEMAS: dict[str, str] = {
    "dag_run": "dag_id string, run_id string, state string, execution_date timestamp, start_date timestamp, "
    "end_date timestamp",
    "task_instance": "dag_id string, task_id string, run_id string, state string, try_number int, "
    "execution_date timestamp, queued_dttm timestamp, start_date timestamp, end_date timestamp, pool string, "
    "hostname string, pid int",
    "task_fail": "dag_id string, task_id string, start_date timestamp, end_date timestamp",
    "sla_miss": "dag_id string, task_id string, execution_date timestamp, timestamp timestamp",
    "job": "hostname string, job_type string, latest_heartbeat timestamp",
    "slot_pool": "pool string, slots int",
    "log": "dttm timestamp",
    "serialized_dag": "dag_id string, fileloc string, data string, data_compressed binary, last_updated timestamp, "
    "dag_hash string, processor_subdir string",
    "settings": "env string, captured_at timestamp, section string, setting string, value string",
    "ab_user": "id int, username string, first_name string, last_name string, email string, active boolean, "
    "created_on timestamp, changed_on timestamp",
    "ab_role": "id int, name string",
    "ab_user_role": "user_id int, role_id int",
    "ab_permission": "id int, name string",
    "ab_view_menu": "id int, name string",
    "ab_permission_view": "id int, permission_id int, view_menu_id int",
    "ab_permission_view_role": "permission_view_id int, role_id int",
    "group_map": "precedence int, idp_group string, iam_role string, app_role string, specific_dags array<string>",
    "logins": "user_id int, username string, groups string",
    "file_inventory": "path string, size_bytes bigint",
    "table_sizes": "schemaname string, tablename string, total_size_bytes bigint, table_size_bytes bigint",
    "index_usage": "schemaname string, tablename string, indexname string, index_scans bigint, tuples_read bigint, "
    "tuples_fetched bigint, index_size_bytes bigint",
    "activity": "pid int, usename string, application_name string, state string, query string, "
    "wait_event_type string, wait_event string, query_start timestamp, backend_start timestamp",
    "locks": "pid int, locktype string, mode string, granted boolean",
    "dag_defs": "dag_id string, schedule_interval string, tags array<string>",
    "task_defs": "dag_id string, task_id string, retries int",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])
