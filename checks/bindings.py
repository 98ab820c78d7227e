"""Telemetry tables derived from the given tables, in Spark and as SQL text for the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# end of the data of each group of tables
ORDERS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

# fixed values: end of data per table
AS_OF = {
    "task_instance": ORDERS_AS_OF,
    "dag_run": ORDERS_AS_OF,
    "activity": ORDERS_AS_OF,
    "task_fail": EVENTS_AS_OF,
    "sla_miss": EVENTS_AS_OF,
    "job": EVENTS_AS_OF,
    "log": EVENTS_AS_OF,
    "serialized_dag": EVENTS_AS_OF,
}


def _plus(ts: str, seconds: str) -> str:
    return f"timestampadd(SECOND, CAST({seconds} AS INT), {ts})"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(name: str) -> str:
    return f"CAST({name} AS TIMESTAMP)"


def _task_instance(spark: SparkSession, sf: str) -> DataFrame:
    li = _source(spark, sf, "lineitem").withColumn("ship", F.expr(_ts("l_shipdate")))
    li = li.withColumn("start_date", F.expr(_plus("ship", "(l_orderkey * 7919 + l_linenumber * 104729) % 86400")))
    state = F.expr(
        "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' "
        "WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 7 THEN 'running' "
        "WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 6 THEN 'queued' ELSE 'success' END"
    )
    return li.withColumn("state", state).selectExpr(
        "concat('dag_', l_suppkey % 10) AS dag_id",
        "concat('task_', l_partkey % 20) AS task_id",
        "concat('scheduled__', date_format(ship, 'yyyy-MM-dd')) AS run_id",
        "state",
        "1 + l_linenumber % 4 AS try_number",
        "ship AS execution_date",
        f"{_plus('start_date', '-((l_partkey * 13) % 900)')} AS queued_dttm",
        "start_date",
        "CASE WHEN state NOT IN ('running', 'queued') THEN "
        f"{_plus('start_date', 'CAST(l_quantity AS BIGINT) * 60 + l_partkey % 300')} END AS end_date",
        "CASE WHEN l_suppkey % 6 = 0 THEN 'default_pool' ELSE concat('pool_', l_suppkey % 6) END AS pool",
        "concat('host_', l_suppkey % 4) AS hostname",
        "CAST(l_orderkey % 10000 AS INT) AS pid",
    )


def _dag_run(spark: SparkSession, sf: str) -> DataFrame:
    o = _source(spark, sf, "orders").withColumn(
        "execution_date", F.expr(_plus(_ts("o_orderdate"), "(o_orderkey * 7919) % 86400"))
    )
    state = F.expr(
        "CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'failed' "
        "WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'queued' "
        "WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'running' ELSE 'success' END"
    )
    o = o.withColumn("state", state).withColumn(
        "start_date",
        F.expr(f"CASE WHEN state <> 'queued' THEN {_plus('execution_date', '(o_orderkey * 37) % 5400')} END"),
    )
    return o.selectExpr(
        "concat('dag_', o_custkey % 25) AS dag_id",
        "CAST(o_orderkey AS STRING) AS run_id",
        "state",
        "execution_date",
        "start_date",
        "CASE WHEN state IN ('success', 'failed') THEN "
        f"{_plus('start_date', 'CAST(floor(o_totalprice) AS BIGINT) % 7200')} END AS end_date",
    )


def _events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return _source(spark, sf, "events").where(F.col("event_type") == kind).withColumn("ts", F.expr(_ts("ts")))


def _task_fail(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf, "error").selectExpr(
        "concat('dag_', user_id % 3) AS dag_id",
        "concat('task_', user_id % 12) AS task_id",
        "ts AS start_date",
        f"{_plus('ts', 'floor(value)')} AS end_date",
    )


def _sla_miss(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf, "view").selectExpr(
        "concat('dag_', user_id % 3) AS dag_id",
        "concat('task_', user_id % 12) AS task_id",
        f"{_plus('ts', '-(event_id % 3600)')} AS execution_date",
        "ts AS timestamp",
    )


def _job(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf, "click").selectExpr(
        "concat('host_', user_id % 8) AS hostname",
        "CASE WHEN user_id % 5 = 0 THEN 'TriggererJob' ELSE 'SchedulerJob' END AS job_type",
        "ts AS latest_heartbeat",
    )


def _event_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that last as many seconds as an event's value; those of no or a negative value have not ended."""
    events = _source(spark, sf, "events").withColumn("ts", F.expr(_ts("ts")))
    return events.selectExpr(
        "concat('dag_', user_id % 3) AS dag_id",
        "concat('task_', user_id % 12) AS task_id",
        "'success' AS state",
        "ts AS start_date",
        "CASE WHEN value > 0 THEN timestamp_micros(unix_micros(ts) + CAST(round(value * 1000000) AS BIGINT)) END AS end_date",
    )


def _slot_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = F.expr("concat('pool_', s_suppkey % 6)").alias("pool")
    return (
        _source(spark, sf, "supplier")
        .where(F.expr("s_suppkey % 6 BETWEEN 1 AND 4"))
        .groupBy(pool)
        .agg(F.count(F.lit(1)).cast("int").alias("slots"))
    )


def _serialized_dag(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "documents").selectExpr(
        "source AS dag_id",
        "concat('/dags/', source, '/', doc_id, '.py') AS fileloc",
        "text AS data",
        "CASE WHEN doc_id % 4 = 0 THEN CAST(text AS BINARY) END AS data_compressed",
        f"TIMESTAMP '{EVENTS_AS_OF}' - make_dt_interval(CAST(doc_id % 30 AS INT)) AS last_updated",
        "md5(text) AS dag_hash",
        "lang AS processor_subdir",
    )


def _page_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "pages").selectExpr(
        "concat('page_', page_id % 10) AS dag_id",
        "url AS fileloc",
        "CASE WHEN page_id % 5 = 0 THEN replace(html, '}', '') ELSE html END AS data",
        f"TIMESTAMP '{EVENTS_AS_OF}' AS last_updated",
        "md5(html) AS dag_hash",
    )


def _json_documents(spark: SparkSession, sf: str) -> DataFrame:
    props = _source(spark, sf, "events").selectExpr("concat('event_', event_id) AS dag_id", "props AS data")
    texts = _source(spark, sf, "documents").selectExpr("concat('doc_', doc_id) AS dag_id", "text AS data")
    talks = _source(spark, sf, "conversations").selectExpr(
        "concat('talk_', conv_id, '_', turn) AS dag_id",
        "to_json(named_struct('conv', conv_id, 'turns', array(named_struct('role', role, 'text', text)))) AS data",
    )
    return props.unionByName(texts).unionByName(talks)


def _json_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Events deep inside lists and beside long numbers."""
    return _source(spark, sf, "events").selectExpr(
        "event_id",
        """concat(repeat('[', cast(event_id % 1700 AS int)), '{"p":', props, ',"n":', repeat('7', 1 + cast(event_id % 1300 AS int)),
            '}', repeat(']', cast(event_id % 1700 AS int))) AS data""",
    )


def _json_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with references, markers, long strings, nesting and repeated beginnings, each in some of them."""
    return _source(spark, sf, "events").selectExpr(
        "concat('dag_', event_id) AS dag_id",
        f"""CASE WHEN event_id % 11 = 0 THEN concat({_REPEATED.format(int="int")}) ELSE concat({_MARKED.format(int="int")}) END AS data""",
    )


# plain text functions that both engines have
_REPEATED = """repeat(concat('{{"k":"', repeat('v', 140), '","c":'), cast(event_id % 13 AS {int})), event_id,
    repeat('}}', cast(event_id % 13 AS {int}))"""
_MARKED = """'{{"a":[', repeat('{{"_dag":1}},', cast(event_id % 4 AS {int})), repeat('{{"task_id":2}},', cast(event_id % 5 AS {int})),
    CASE event_id % 3 WHEN 0 THEN '"pickle",' WHEN 1 THEN '"__reduce__",' ELSE '' END,
    '"', repeat('x', cast(event_id % 50 AS {int})), '",', repeat('[', cast(event_id % 6 AS {int})), event_id,
    repeat(']', cast(event_id % 6 AS {int})), ']}}'"""


# fixed values: settings of the derived snapshots: section, setting, value expression over supplier
_SETTINGS = [
    ("core", "parallelism", "s_suppkey * 13 % 140 + CASE WHEN snap = 2 AND s_suppkey % 3 = 0 THEN 1 ELSE 0 END"),
    ("core", "max_active_tasks_per_dag", "1 + s_suppkey % 40"),
    ("core", "dagbag_import_timeout", "20 + s_suppkey % 50"),
    ("core", "dag_file_processor_timeout", "50"),
    ("scheduler", "parsing_processes", "s_suppkey % 11"),
    ("scheduler", "dag_dir_list_interval", "s_suppkey * 17 % 700"),
    ("celery", "worker_concurrency", "s_suppkey * 7 % 50"),
    ("database", "sql_alchemy_pool_size", "s_suppkey % 60"),
    ("core", "executor", "CASE s_suppkey % 4 WHEN 0 THEN 'CeleryExecutor' WHEN 1 THEN 'LocalExecutor' "
     "WHEN 2 THEN 'KubernetesExecutor' ELSE 'SequentialExecutor' END"),
    ("core", "store_serialized_dags", "CASE s_suppkey % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN '1' ELSE 'yes' END"),
    ("core", "compress_serialized_dags", "CASE s_suppkey % 3 WHEN 0 THEN 'Yes' ELSE 'no' END"),
]
_BROKER = (
    "celery",
    "broker_url",
    "CASE s_suppkey % 3 WHEN 0 THEN 'redis://queue' WHEN 1 THEN 'sqs://queue' ELSE 'amqp://queue' END",
)


def _setting_value(section: str, setting: str, value: str, text_type: str) -> str:
    if setting == "broker_url":
        return value
    text = f"CAST({value} AS {text_type})"
    invalid = f"WHEN s_suppkey % 9 = 0 THEN 'abc' " if setting == "parallelism" else ""
    return f"CASE WHEN s_suppkey % 10 = 0 THEN 'NOT_SET' {invalid}ELSE {text} END"


def _settings(spark: SparkSession, sf: str) -> DataFrame:
    supplier = _source(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("snap"))
    rows = ", ".join(
        f"named_struct('section', '{s}', 'setting', '{n}', 'value', {_setting_value(s, n, v, 'STRING')})"
        for s, n, v in [*_SETTINGS, _BROKER]
    )
    return supplier.selectExpr(
        "concat('env_', s_suppkey) AS env",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(snap - 1) AS captured_at",
        f"inline(array({rows}))",
    )


def _ab_role(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "region").selectExpr(
        "CAST(r_regionkey + 1 AS INT) AS id",
        "element_at(array('Admin', 'Op', 'User', 'Viewer', 'Public'), CAST(r_regionkey + 1 AS INT)) AS name",
    )


def _ab_permission(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "region").selectExpr(
        "CAST(r_regionkey + 1 AS INT) AS id",
        "element_at(array('can_read', 'can_edit', 'can_create', 'can_delete', 'menu_access'), "
        "CAST(r_regionkey + 1 AS INT)) AS name",
    )


def _ab_view_menu(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "nation").selectExpr(
        "CAST(n_nationkey + 1 AS INT) AS id",
        "CASE WHEN n_nationkey = 0 THEN 'DAGs' WHEN n_nationkey < 10 THEN concat('DAG:dag_', n_nationkey) "
        "ELSE n_name END AS name",
    )


def _ab_permission_view(spark: SparkSession, sf: str) -> DataFrame:
    return _ab_view_menu(spark, sf).selectExpr(
        "id AS view_menu_id", "explode(sequence(1, 5)) AS permission_id"
    ).selectExpr("(view_menu_id - 1) * 5 + permission_id AS id", "permission_id", "view_menu_id")


def _ab_permission_view_role(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _ab_permission_view(spark, sf)
        .selectExpr("id AS permission_view_id", "explode(sequence(1, 5)) AS role_id")
        .where("(permission_view_id + role_id) % 3 <> 0")
    )


def _ab_user(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS INT) AS id",
        "concat(c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '_' END, "
        "CAST(floor(c_custkey / 2) AS BIGINT)) AS username",
        "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS first_name",
        "c_mktsegment AS last_name",
        "concat(lower(c_name), '@example.com') AS email",
        "c_custkey % 7 <> 0 AS active",
        "TIMESTAMP '2024-01-01 00:00:00' AS created_on",
        "TIMESTAMP '2024-01-01 00:00:00' AS changed_on",
    )


def _ab_user_role(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS INT) AS user_id", "CAST(c_nationkey % 5 + 1 AS INT) AS role_id"
    )


def _group_map(spark: SparkSession, sf: str) -> DataFrame:
    names = {0: "Admin", 1: "User", 2: "Viewer", 3: "Restricted"}
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in names.items())
    return _source(spark, sf, "region").where("r_regionkey < 4").selectExpr(
        "CAST(r_regionkey + 1 AS INT) AS precedence",
        "concat('g', r_regionkey) AS idp_group",
        "concat('iam_', r_regionkey) AS iam_role",
        f"CASE r_regionkey {cases} END AS app_role",
        "CASE WHEN r_regionkey = 3 THEN array('dag_1', 'dag_2') END AS specific_dags",
    )


def _logins(spark: SparkSession, sf: str) -> DataFrame:
    users = _ab_user(spark, sf).select(F.col("id").alias("user_id"), "username")
    groups = _source(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS INT) AS user_id", "concat('[g', c_custkey % 7, ', g', c_nationkey % 7, ']') AS groups"
    )
    return groups.join(users, "user_id")


def _file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "pages").selectExpr(
        "concat('dags/', page_id, CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.SQL' WHEN 2 THEN '.csv' ELSE '' END) "
        "AS path",
        "CAST(octet_length(html) AS BIGINT) AS size_bytes",
    )


def _table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "part").selectExpr(
        "'public' AS schemaname",
        "concat(p_name, ' ', p_partkey) AS tablename",
        "p_partkey * 1000003 AS total_size_bytes",
        "CAST(p_partkey * 1000003 * 7 DIV 10 AS BIGINT) AS table_size_bytes",
    )


def _index_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "part").selectExpr(
        "'public' AS schemaname",
        "p_name AS tablename",
        "concat('idx_', p_partkey) AS indexname",
        "CAST(p_size % 5 AS BIGINT) AS index_scans",
        "CAST(p_size * 10 AS BIGINT) AS tuples_read",
        "CAST(p_size * 7 AS BIGINT) AS tuples_fetched",
        "p_partkey * 100003 AS index_size_bytes",
    )


def _activity(spark: SparkSession, sf: str) -> DataFrame:
    start = f"TIMESTAMP '{ORDERS_AS_OF}' - make_dt_interval(0, 0, CAST(c_custkey AS INT))"
    return _source(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS INT) AS pid",
        "c_name AS usename",
        "c_mktsegment AS application_name",
        "element_at(array('active', 'idle', 'idle in transaction', 'active'), CAST(c_custkey % 4 + 1 AS INT)) AS state",
        "concat('select ', c_custkey) AS query",
        "CASE WHEN c_custkey % 3 <> 0 THEN 'Lock' END AS wait_event_type",
        "CASE WHEN c_custkey % 3 <> 0 THEN 'relation' END AS wait_event",
        f"{start} AS query_start",
        f"{start} AS backend_start",
    )


def _locks(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "orders").selectExpr(
        "CAST(o_custkey AS INT) AS pid",
        "concat('lock_', o_orderkey) AS locktype",
        "o_orderpriority AS mode",
        "o_orderkey % 5 <> 0 AS granted",
    )


def _dag_defs(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "part").selectExpr(
        "concat('dag_', p_partkey) AS dag_id",
        "CASE WHEN p_size % 7 = 0 THEN '@once' ELSE '@daily' END AS schedule_interval",
        "CASE WHEN p_partkey % 4 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(p_brand) END AS tags",
    )


def _task_defs(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "part").selectExpr(
        "concat('dag_', p_partkey % 100) AS dag_id",
        "concat('task_', p_partkey) AS task_id",
        "CASE WHEN p_size % 5 <> 0 THEN p_size % 3 END AS retries",
    )


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "events").selectExpr(f"{_ts('ts')} AS dttm")


def _xcom(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "conversations").select("conv_id", "turn")


_BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "task_instance": _task_instance,
    "dag_run": _dag_run,
    "task_fail": _task_fail,
    "sla_miss": _sla_miss,
    "job": _job,
    "event_runs": _event_runs,
    "slot_pool": _slot_pool,
    "log": _log,
    "xcom": _xcom,
    "serialized_dag": _serialized_dag,
    "page_documents": _page_documents,
    "json_documents": _json_documents,
    "json_nested": _json_nested,
    "json_marked": _json_marked,
    "settings": _settings,
    "ab_role": _ab_role,
    "ab_permission": _ab_permission,
    "ab_view_menu": _ab_view_menu,
    "ab_permission_view": _ab_permission_view,
    "ab_permission_view_role": _ab_permission_view_role,
    "ab_user": _ab_user,
    "ab_user_role": _ab_user_role,
    "group_map": _group_map,
    "logins": _logins,
    "file_inventory": _file_inventory,
    "table_sizes": _table_sizes,
    "index_usage": _index_usage,
    "activity": _activity,
    "locks": _locks,
    "dag_defs": _dag_defs,
    "task_defs": _task_defs,
}

RBAC = ["ab_role", "ab_permission", "ab_view_menu", "ab_permission_view", "ab_permission_view_role", "ab_user", "ab_user_role"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one by its own name."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name not in _BUILDERS:
        return _source(spark, sf_dir, name)
    return _BUILDERS[name](spark, sf_dir)


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


# The same tables as SQL over the given ones.
_JSON_TALK = (
    "'{\"conv\":' || conv_id || ',\"turns\":[' || to_json(struct_pack(\"role\" := role, \"text\" := \"text\")) || ']}'"
)
_SETTING_ROWS = " UNION ALL ".join(
    f"SELECT 'env_' || s_suppkey AS env, TIMESTAMP '2024-01-01 00:00:00' + to_days(snap - 1) AS captured_at, "
    f"'{s}' AS section, '{n}' AS setting, {_setting_value(s, n, v, 'VARCHAR')} AS value "
    f"FROM supplier, (VALUES (1), (2)) AS t(snap)"
    for s, n, v in [*_SETTINGS, _BROKER]
)

SQL: dict[str, str] = {
    "task_instance": """
        SELECT 'dag_' || (l_suppkey % 10) AS dag_id, 'task_' || (l_partkey % 20) AS task_id,
               'scheduled__' || strftime(l_shipdate, '%Y-%m-%d') AS run_id, state, 1 + l_linenumber % 4 AS try_number,
               l_shipdate AS execution_date, start_date - to_seconds((l_partkey * 13) % 900) AS queued_dttm, start_date,
               CASE WHEN state NOT IN ('running', 'queued')
                    THEN start_date + to_seconds(CAST(l_quantity AS BIGINT) * 60 + l_partkey % 300) END AS end_date,
               CASE WHEN l_suppkey % 6 = 0 THEN 'default_pool' ELSE 'pool_' || (l_suppkey % 6) END AS pool,
               'host_' || (l_suppkey % 4) AS hostname, CAST(l_orderkey % 10000 AS INTEGER) AS pid
        FROM (SELECT *, l_shipdate + to_seconds((l_orderkey * 7919 + l_linenumber * 104729) % 86400) AS start_date,
                     CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed'
                          WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 7 THEN 'running'
                          WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 6 THEN 'queued'
                          ELSE 'success' END AS state
              FROM lineitem)""",
    "dag_run": """
        SELECT dag_id, run_id, state, execution_date, start_date,
               CASE WHEN state IN ('success', 'failed')
                    THEN start_date + to_seconds(CAST(floor(o_totalprice) AS BIGINT) % 7200) END AS end_date
        FROM (SELECT *, CASE WHEN state <> 'queued' THEN execution_date + to_seconds((o_orderkey * 37) % 5400) END
                          AS start_date
              FROM (SELECT 'dag_' || (o_custkey % 25) AS dag_id, CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey,
                           o_totalprice, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS execution_date,
                           CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'failed'
                                WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'queued'
                                WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'running'
                                ELSE 'success' END AS state
                    FROM orders))""",
    "task_fail": """
        SELECT 'dag_' || (user_id % 3) AS dag_id, 'task_' || (user_id % 12) AS task_id, ts AS start_date,
               ts + to_seconds(CAST(floor(value) AS BIGINT)) AS end_date
        FROM events WHERE event_type = 'error'""",
    "sla_miss": """
        SELECT 'dag_' || (user_id % 3) AS dag_id, 'task_' || (user_id % 12) AS task_id,
               ts - to_seconds(event_id % 3600) AS execution_date, ts AS "timestamp"
        FROM events WHERE event_type = 'view'""",
    "job": """
        SELECT 'host_' || (user_id % 8) AS hostname,
               CASE WHEN user_id % 5 = 0 THEN 'TriggererJob' ELSE 'SchedulerJob' END AS job_type, ts AS latest_heartbeat
        FROM events WHERE event_type = 'click'""",
    "slot_pool": """
        SELECT 'pool_' || (s_suppkey % 6) AS pool, CAST(COUNT(*) AS INTEGER) AS slots
        FROM supplier WHERE s_suppkey % 6 BETWEEN 1 AND 4 GROUP BY 1""",
    "log": "SELECT ts AS dttm FROM events",
    "xcom": "SELECT conv_id, turn FROM conversations",
    "serialized_dag": f"""
        SELECT source AS dag_id, '/dags/' || source || '/' || doc_id || '.py' AS fileloc, "text" AS data,
               CASE WHEN doc_id % 4 = 0 THEN encode("text") END AS data_compressed,
               TIMESTAMP '{EVENTS_AS_OF}' - to_days(CAST(doc_id % 30 AS INTEGER)) AS last_updated,
               md5("text") AS dag_hash, lang AS processor_subdir
        FROM documents""",
    "page_documents": f"""
        SELECT 'page_' || (page_id % 10) AS dag_id, url AS fileloc,
               CASE WHEN page_id % 5 = 0 THEN replace(html, '}}', '') ELSE html END AS data,
               TIMESTAMP '{EVENTS_AS_OF}' AS last_updated, md5(html) AS dag_hash
        FROM pages""",
    "json_documents": f"""
        SELECT 'event_' || event_id AS dag_id, props AS data FROM events
        UNION ALL SELECT 'doc_' || doc_id, "text" FROM documents
        UNION ALL SELECT 'talk_' || conv_id || '_' || turn, {_JSON_TALK} FROM conversations""",
    "json_nested": """
        SELECT event_id, repeat('[', event_id % 1700) || '{"p":' || props || ',"n":' || repeat('7', 1 + event_id % 1300)
            || '}' || repeat(']', event_id % 1700) AS data FROM events""",
    "json_marked": f"""
        SELECT 'dag_' || event_id AS dag_id,
            CASE WHEN event_id % 11 = 0 THEN concat({_REPEATED.format(int="bigint")})
                ELSE concat({_MARKED.format(int="bigint")}) END AS data FROM events""",
    "settings": _SETTING_ROWS,
    "ab_role": """
        SELECT r_regionkey + 1 AS id, ['Admin', 'Op', 'User', 'Viewer', 'Public'][r_regionkey + 1] AS name FROM region""",
    "ab_permission": """
        SELECT r_regionkey + 1 AS id,
               ['can_read', 'can_edit', 'can_create', 'can_delete', 'menu_access'][r_regionkey + 1] AS name
        FROM region""",
    "ab_view_menu": """
        SELECT n_nationkey + 1 AS id, CASE WHEN n_nationkey = 0 THEN 'DAGs'
               WHEN n_nationkey < 10 THEN 'DAG:dag_' || n_nationkey ELSE n_name END AS name
        FROM nation""",
    "ab_permission_view": """
        SELECT n_nationkey * 5 + r_regionkey + 1 AS id, r_regionkey + 1 AS permission_id, n_nationkey + 1 AS view_menu_id
        FROM nation, region""",
    "ab_permission_view_role": """
        SELECT v.id AS permission_view_id, r.r_regionkey + 1 AS role_id
        FROM (SELECT n_nationkey * 5 + r_regionkey + 1 AS id FROM nation, region) v, region r
        WHERE (v.id + r.r_regionkey + 1) % 3 <> 0""",
    "ab_user": """
        SELECT CAST(c_custkey AS INTEGER) AS id,
               c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '_' END || (c_custkey // 2) AS username,
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS first_name, c_mktsegment AS last_name,
               lower(c_name) || '@example.com' AS email, c_custkey % 7 <> 0 AS active,
               TIMESTAMP '2024-01-01 00:00:00' AS created_on, TIMESTAMP '2024-01-01 00:00:00' AS changed_on
        FROM customer""",
    "ab_user_role": """
        SELECT CAST(c_custkey AS INTEGER) AS user_id, c_nationkey % 5 + 1 AS role_id FROM customer""",
    "group_map": """
        SELECT r_regionkey + 1 AS precedence, 'g' || r_regionkey AS idp_group, 'iam_' || r_regionkey AS iam_role,
               ['Admin', 'User', 'Viewer', 'Restricted'][r_regionkey + 1] AS app_role,
               CASE WHEN r_regionkey = 3 THEN ['dag_1', 'dag_2'] END AS specific_dags
        FROM region WHERE r_regionkey < 4""",
    "logins": """
        SELECT CAST(c_custkey AS INTEGER) AS user_id,
               c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '_' END || (c_custkey // 2) AS username,
               '[g' || (c_custkey % 7) || ', g' || (c_nationkey % 7) || ']' AS groups
        FROM customer""",
    "file_inventory": """
        SELECT 'dags/' || page_id || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.SQL' WHEN 2 THEN '.csv' ELSE '' END
                 AS path, CAST(strlen(html) AS BIGINT) AS size_bytes
        FROM pages""",
    "table_sizes": """
        SELECT 'public' AS schemaname, p_name || ' ' || p_partkey AS tablename, p_partkey * 1000003 AS total_size_bytes,
               p_partkey * 1000003 * 7 // 10 AS table_size_bytes
        FROM part""",
    "index_usage": """
        SELECT 'public' AS schemaname, p_name AS tablename, 'idx_' || p_partkey AS indexname,
               CAST(p_size % 5 AS BIGINT) AS index_scans, CAST(p_size * 10 AS BIGINT) AS tuples_read,
               CAST(p_size * 7 AS BIGINT) AS tuples_fetched, p_partkey * 100003 AS index_size_bytes
        FROM part""",
    "activity": f"""
        SELECT CAST(c_custkey AS INTEGER) AS pid, c_name AS usename, c_mktsegment AS application_name,
               ['active', 'idle', 'idle in transaction', 'active'][c_custkey % 4 + 1] AS state,
               'select ' || c_custkey AS query, CASE WHEN c_custkey % 3 <> 0 THEN 'Lock' END AS wait_event_type,
               CASE WHEN c_custkey % 3 <> 0 THEN 'relation' END AS wait_event,
               TIMESTAMP '{ORDERS_AS_OF}' - to_minutes(c_custkey) AS query_start,
               TIMESTAMP '{ORDERS_AS_OF}' - to_minutes(c_custkey) AS backend_start
        FROM customer""",
    "locks": """
        SELECT CAST(o_custkey AS INTEGER) AS pid, 'lock_' || o_orderkey AS locktype, o_orderpriority AS mode,
               o_orderkey % 5 <> 0 AS granted
        FROM orders""",
    "dag_defs": """
        SELECT 'dag_' || p_partkey AS dag_id, CASE WHEN p_size % 7 = 0 THEN '@once' ELSE '@daily' END AS schedule_interval,
               CASE WHEN p_partkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_brand] END AS tags
        FROM part""",
    "task_defs": """
        SELECT 'dag_' || (p_partkey % 100) AS dag_id, 'task_' || p_partkey AS task_id,
               CASE WHEN p_size % 5 <> 0 THEN p_size % 3 END AS retries
        FROM part""",
}


def twin(names: list[str], body: str) -> str:
    """SQL that defines the named tables as CTEs and runs ``body``, which may go on with CTEs of its own."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    joiner = ",\n" if body.lstrip()[:5].upper() == "WITH " else "\n"
    rest = body.lstrip()[5:] if joiner.startswith(",") else body
    return f"WITH {ctes}{joiner}{rest}"
