"""Source and export queries."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runscope.operators import failures, inventory, runs
from runscope.plans import diagnostics, findings, recommendations, report
from runscope.sources import export, tables

from .bindings import AS_OF, RBAC
from .q_failures import FAILURES
from .q_people import PERMISSION_TABLES
from .q_runs import EVENT, PERFORMANCE, RUN
from .register import EVENTS_AS_OF, ORDERS_AS_OF, ORDERS_DAYS, Get, big, checkpoint_folder, query, rnd, sec, uncut

ORDERS_NOW = datetime.fromisoformat(ORDERS_AS_OF)
EVENTS_NOW = datetime.fromisoformat(EVENTS_AS_OF)
DAYS = 90


@query("s01_read_table", ["dag_run"], "SELECT state, COUNT(*) AS runs FROM dag_run GROUP BY state")
def _(t: Get):
    t("dag_run").createOrReplaceTempView("checked_dag_run")
    spark = t("dag_run").sparkSession
    return tables.read_table(spark, "checked_dag_run").groupBy("state").agg(F.count(F.lit(1)).alias("runs"))


@query("s05_register_views", PERMISSION_TABLES, """
SELECT kind, COUNT(*) AS views, COUNT(DISTINCT permission_id) AS permissions FROM (
    SELECT permission_id, CASE WHEN view_menu_id IN (SELECT id FROM ab_view_menu WHERE regexp_matches(name, '^DAG(s|:)'))
        THEN 'workflow' ELSE 'other' END AS kind FROM ab_permission_view) GROUP BY kind""")
def _(t: Get):
    """Permission views on workflows and on other pages, by SQL over the registered views."""
    tables.register_views({n: t(n) for n in RBAC})
    return t("ab_role").sparkSession.sql("""
        with pages as (select id as page, if(startswith(name, 'DAG:') or startswith(name, 'DAGs'), 'workflow', 'other') as kind
                       from ab_view_menu)
        select coalesce(kind, 'other') as kind, count(*) as views, count(distinct permission_id) as permissions
        from ab_permission_view left join pages on page = view_menu_id group by all""")


IDS = """ids AS (SELECT DISTINCT source AS dag_id FROM documents WHERE doc_id % 7 = 0
  UNION SELECT 'missing_' || n_name FROM nation)"""


def _ids(t: Get):
    known = t("documents").where("doc_id % 7 = 0").select(F.col("source").alias("dag_id"))
    unknown = t("nation").select(F.concat(F.lit("missing_"), "n_name").alias("dag_id"))
    return known.unionByName(unknown).distinct()


@query("s07_select_by_ids", ["serialized_dag"], f"""WITH {IDS}
SELECT dag_id, fileloc, {big("length(data)")} AS size_bytes, {rnd("length(data) / 1048576", 2)} AS size_mb, last_updated,
       dag_hash FROM serialized_dag WHERE dag_id IN (SELECT dag_id FROM ids)""")
def _(t: Get):
    return tables.select_by_ids(t("serialized_dag"), _ids(t))[0]


@query("s07_missing_ids", ["serialized_dag"], f"""WITH {IDS}
SELECT dag_id FROM ids WHERE dag_id NOT IN (SELECT dag_id FROM serialized_dag)""")
def _(t: Get):
    return tables.select_by_ids(t("serialized_dag"), _ids(t))[1]


CUTOFF = f"CAST(TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL {DAYS} DAY AS DATE)"


@query("k01_export_window", ["task_instance"], f"""
SELECT dag_id, task_id, run_id, state, start_date, end_date FROM task_instance WHERE start_date >= {CUTOFF}""")
def _(t: Get):
    rows = export.export_window(t("task_instance"), "start_date", ORDERS_NOW, max_age_days=DAYS)
    return rows.select("dag_id", "task_id", "run_id", "state", "start_date", "end_date")


@query("k01_export_window_text", ["dag_run"], f"""
SELECT run_id, strftime(execution_date, '%Y-%m-%d %H:%M:%S') AS execution_date FROM dag_run
WHERE execution_date >= {CUTOFF}""")
def _(t: Get):
    dag_run = t("dag_run").select("run_id", F.date_format("execution_date", "yyyy-MM-dd HH:mm:ss").alias("execution_date"))
    return export.export_window(dag_run, "execution_date", ORDERS_NOW, max_age_days=DAYS)


EXPORTED = {"dag_run": "execution_date", "task_instance": "start_date", "slot_pool": None, "job": None}
COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", COUNT(*) AS rows FROM {n}" + (f" WHERE {c} >= {CUTOFF}" if c else "")
    for n, c in EXPORTED.items()
) + ")"


def _counts(t: Get):
    items = [export.ExportItem(n, c) for n, c in EXPORTED.items()]
    return export.export_counts({n: t(n) for n in EXPORTED}, items, ORDERS_NOW, max_age_days=DAYS)


@query("k04_export_counts", list(EXPORTED), f"WITH {COUNTS} SELECT * FROM counts")
def _(t: Get):
    return _counts(t)


@query("k04_export_manifest", list(EXPORTED), f"""WITH {COUNTS}
SELECT '2001-08-02 00:00:00 UTC' AS export_timestamp, 'metadata' AS database_name, strftime({CUTOFF}, '%Y-%m-%d')
         AS cutoff_date, {big(str(DAYS))} AS max_age_days, COUNT(*) AS total_tables, {big("SUM(rows)")} AS total_rows,
       string_agg("table" || '=' || rows, ',' ORDER BY "table") AS tables FROM counts""")
def _(t: Get):
    manifest = export.export_manifest(_counts(t), ORDERS_NOW, database="metadata", max_age_days=DAYS)
    pairs = F.transform(F.map_entries("tables"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return manifest.withColumn("tables", F.array_join(F.array_sort(pairs), ","))


LATEST = """latest AS (SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY dag_id ORDER BY last_updated DESC, dag_hash DESC) AS no FROM serialized_dag)
  WHERE no = 1)"""
DATA = "CASE WHEN json_valid(data) THEN data ELSE CAST(to_json(data) AS VARCHAR) END"
ABOUT = """'{"dag_id":"' || dag_id || '","fileloc":"' || fileloc || '","last_updated":"' ||
  strftime(last_updated, '%Y-%m-%dT%H:%M:%S') || '","dag_hash":"' || dag_hash || '","processor_subdir":"' ||
  processor_subdir || '","serialized_size_bytes":' || length(data) || ',"has_compressed_data":' ||
  CASE WHEN octet_length(data_compressed) > 0 THEN 'true' ELSE 'false' END || '}'"""
HEAD = """'{"export_metadata":{"exported_at":"2024-01-31T00:00:00","exported_by":"export_documents",'
  || '"source_environment":"prod","source_version":"Unknown"},"dag_metadata":'"""


@query("k05_export_documents", ["serialized_dag"], f"""WITH {LATEST}
SELECT dag_id, {HEAD} || {ABOUT} || ',"serialized_data":' || {DATA} || '}}' AS content FROM latest""")
def _(t: Get):
    latest = export.latest_versions(t("serialized_dag"))
    return export.export_documents(latest, as_of=EVENTS_AS_OF, environment="prod")


@query("k05_export_documents_bare", ["json_documents"], f"""
SELECT dag_id, '{{"dag_id":"' || dag_id || '","serialized_data":' || {DATA} || '}}' AS content FROM json_documents""")
def _(t: Get):
    return export.export_documents(t("json_documents"), as_of=EVENTS_AS_OF, include_metadata=False)


REPORT = f"""{IDS}, done AS (
  SELECT dag_id, SUM(strlen('{{"dag_id":"' || dag_id || '","serialized_data":' || {DATA} || '}}')) AS bytes
  FROM serialized_dag WHERE dag_id IN (SELECT dag_id FROM ids) GROUP BY dag_id),
report AS (SELECT ids.dag_id, {big("bytes")} AS file_size_bytes,
                  CASE WHEN bytes IS NULL THEN 'missing' ELSE 'success' END AS status FROM ids LEFT JOIN done USING (dag_id))"""


def _report(t: Get):
    ids = _ids(t)
    wanted = t("serialized_dag").join(ids, "dag_id", "left_semi")
    return export.export_report(ids, export.export_documents(wanted, as_of=EVENTS_AS_OF, include_metadata=False))


@query("k06_export_report", ["serialized_dag"], f"WITH {REPORT} SELECT * FROM report")
def _(t: Get):
    return _report(t)


@query("k06_export_report_summary", ["serialized_dag"], f"""WITH {REPORT}
SELECT status, COUNT(*) AS dags, {big("COALESCE(SUM(file_size_bytes), 0)")} AS total_bytes FROM report GROUP BY status""")
def _(t: Get):
    return export.export_report_summary(_report(t))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that checkpoints use."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


@query("s02_list_tables", [], """
SELECT DISTINCT '' AS table_schema, table_name FROM duckdb_columns()
WHERE table_name IN ('lineitem', 'orders', 'documents', 'events')""")
def _(t: Get):
    names = ["lineitem", "orders", "documents", "events"]
    tables.register_views({name: t(name) for name in names}, names)
    return tables.list_tables(t("orders").sparkSession).where(F.col("table_name").isin(*names) & (F.col("table_schema") == ""))


@query("s03_describe_table", [], """
SELECT row_number() OVER (ORDER BY column_index) AS ordinal_position, column_name,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE data_type END AS data_type,
       CASE WHEN is_nullable THEN 'YES' ELSE 'NO' END AS is_nullable
FROM duckdb_columns() WHERE table_name = 'documents'""")
def _(t: Get):
    return tables.describe_table(t("documents"))


@query("s04_sample_probe", ["serialized_dag"], f"""
SELECT dag_id, {big("length(data)")} AS data_length, 'string' AS data_type, {big("octet_length(encode(dag_hash))")} AS dag_hash_length,
       'string' AS dag_hash_type FROM serialized_dag ORDER BY dag_id, last_updated, dag_hash LIMIT 5""")
def _(t: Get):
    order = ["dag_id", "last_updated", "dag_hash"]
    return tables.sample_probe(t("serialized_dag"), ["dag_id", "data", "dag_hash"], rows=5, order=order)


@query("s08_file_inventory", [], """
SELECT 'lineitem.parquet' AS path, true AS has_content, COUNT(*) AS rows FROM lineitem
UNION ALL SELECT 'orders.parquet', true, COUNT(*) FROM orders""")
def _(t: Get):
    """Files of two tables with the rows that Spark reads from each; the file names are those of one file a table."""
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    read = t("lineitem").select(file.alias("path")).unionByName(t("orders").select(file.alias("path")))
    rows = read.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    given = t("lineitem")
    checkpoint_folder(given.sparkSession)  # rounds of the listing are stored there
    listed = tables.file_inventory(given.sparkSession, os.path.dirname(given.inputFiles()[0]))
    listed = listed.select(F.element_at(F.split("path", "/"), -1).alias("path"), (F.col("size_bytes") > 0).alias("has_content"))
    return inventory.visible_files(listed).join(rows, "path")


@query("k02_csv_round_trip", ["task_fail"], """
SELECT dag_id, task_id, strftime(start_date, '%Y-%m-%d %H:%M:%S.%f') AS start_date,
       strftime(end_date, '%Y-%m-%d %H:%M:%S.%f') AS end_date FROM task_fail""")
def _(t: Get):
    spark = t("task_fail").sparkSession
    path = _folder(spark, "csv")
    export.write_csv_gz(t("task_fail"), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("k05_written_documents", ["serialized_dag"], f"""WITH {LATEST}
SELECT dag_id, '{{"dag_id":"' || dag_id || '","serialized_data":' || {DATA} || '}}' AS content FROM latest""")
def _(t: Get):
    spark = t("serialized_dag").sparkSession
    path = _folder(spark, "documents")
    latest = export.latest_versions(t("serialized_dag"))
    export.write_documents(export.export_documents(latest, as_of=EVENTS_AS_OF, include_metadata=False), path)
    return spark.read.text(path).select("dag_id", F.col("value").alias("content"))


# the whole report over three results, section by section
REPORT_TEXT = f"""WITH {PERFORMANCE}, {uncut(FAILURES)},
busy AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total_runs DESC, dag_id) AS no FROM perf),
queued AS (SELECT dag_id, COUNT(*) AS n, {sec(f"TIMESTAMP '{ORDERS_AS_OF}'", "MIN(execution_date)")} / 3600 AS age,
    ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, dag_id) AS no FROM dag_run WHERE state = 'queued' GROUP BY dag_id),
failing AS (SELECT *, ROW_NUMBER() OVER (ORDER BY failure_count DESC, dag_id, task_id) AS no FROM fails),
numbers AS (SELECT (SELECT COUNT(*) FROM queued) AS late, (SELECT COALESCE(SUM(n), 0) FROM queued) AS waiting,
    (SELECT COUNT(*) FROM fails) AS tasks, (SELECT AVG(success_rate_percent) FROM perf) AS success),
advice AS (SELECT line, ROW_NUMBER() OVER (ORDER BY rule) AS no FROM (
    SELECT 8 AS rule, printf('Investigate failing runs, the success rate is %.1f percent', success) AS line FROM numbers WHERE success < 95
    UNION ALL SELECT 9, printf('Review %.0f failing tasks', CAST(tasks AS DOUBLE)) FROM numbers WHERE tasks > 10
    UNION ALL SELECT 14, 'Urgent: address 1 critical timing issues' FROM numbers WHERE late > 0
    UNION ALL SELECT 16, printf('Clear the backlog of %.0f queued runs', CAST(waiting AS DOUBLE)) FROM numbers WHERE waiting > 50))
SELECT 'RUN PERFORMANCE' AS line
UNION ALL SELECT printf('%-35s %8d runs %6.2f %% %10s', dag_id, total_runs, success_rate_percent,
    CASE WHEN avg_rt < 3600 THEN printf('%.1fm', avg_rt / 60) ELSE printf('%.1fh', avg_rt / 3600) END) FROM busy WHERE no <= 20
UNION ALL SELECT 'CATCHUP BACKLOG'
UNION ALL SELECT printf('%-35s %8d queued runs, oldest %.1f h', dag_id, n, age) FROM queued WHERE no <= 20
UNION ALL SELECT 'TASK FAILURES'
UNION ALL SELECT printf('%-42s %8d failures on %d days', dag_id || '.' || task_id, failure_count, failure_days) FROM failing WHERE no <= 20
UNION ALL SELECT 'FINDINGS'
UNION ALL SELECT printf('[critical] timing: %.0f workflows have queued runs', CAST(late AS DOUBLE)) FROM numbers WHERE late > 0
UNION ALL SELECT 'RECOMMENDATIONS'
UNION ALL SELECT printf('%d. %s', no, line) FROM advice"""


@query("k07_written_report", ["dag_run", "task_fail"], REPORT_TEXT)
def _(t: Get):
    settings = diagnostics.Settings(as_of=ORDERS_AS_OF, analysis_days=ORDERS_DAYS, history_as_of=AS_OF)
    results = {
        "run_performance": runs.run_performance(t("dag_run"), **RUN),
        "task_failures": failures.task_failures(t("task_fail"), limit=None, **EVENT),
        "catchup_backlog": runs.catchup_backlog(t("dag_run"), as_of=ORDERS_AS_OF, limit=None),
    }
    found = findings.findings(results, settings)
    advice = recommendations.recommendations(recommendations.headline_numbers(results, found), settings)
    spark = t("dag_run").sparkSession
    path = report.report_path(_folder(spark, "report"), "prod", "diagnostics", ORDERS_NOW)
    report.write_report(report.report_lines(results, found, advice), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
