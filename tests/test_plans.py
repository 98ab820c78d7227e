"""Diagnostics from tables to the written report."""

from __future__ import annotations

import glob
from datetime import datetime, timedelta

import pytest

from runscope.operators import failures, runs
from runscope.plans import diagnostics, findings, recommendations, report, settle

from .conftest import as_dicts

NOW = "2024-01-08 00:00:00"
SETTINGS = diagnostics.Settings(as_of=NOW)
DAY = datetime(2024, 1, 5)


@pytest.fixture()
def tables(make):
    def attempt(i, state, seconds, **more):
        start = DAY + timedelta(minutes=i)
        end = start + timedelta(seconds=seconds) if seconds else None
        row = {"dag_id": "d", "task_id": "t", "run_id": f"r{i}", "state": state, "try_number": 1, "queued_dttm": start}
        return {**row, "execution_date": DAY, "start_date": start, "end_date": end, "pool": "p", **more}

    tasks = [attempt(i, "success", 60 + i) for i in range(30)] + [attempt(i, "failed", 5) for i in range(21)]
    tasks += [attempt(0, "running", None), attempt(0, "queued", None)] + [attempt(0, "failed", 5, task_id=f"c{i}", run_id="x") for i in range(3)]
    runs_ = [{"dag_id": "d", "run_id": str(i), "state": "success" if i else "failed", "execution_date": DAY, "start_date": DAY, "end_date": DAY + timedelta(minutes=5)} for i in range(10)]
    runs_ += [{"dag_id": "d", "run_id": "q", "state": "queued", "execution_date": DAY}]
    setting = {"env": "e", "captured_at": DAY, "section": "core"}
    return {
        "task_instance": make("task_instance", tasks),
        "dag_run": make("dag_run", runs_),
        "task_fail": make("task_fail", [{"dag_id": "d", "task_id": f"t{i}", "start_date": DAY} for i in range(12)]),
        "sla_miss": make("sla_miss", [{"dag_id": "d", "task_id": "t", "execution_date": DAY, "timestamp": DAY}]),
        "job": make("job", [{"hostname": "h", "job_type": "SchedulerJob", "latest_heartbeat": DAY + timedelta(minutes=m)} for m in (0, 10)]),
        "slot_pool": make("slot_pool", [{"pool": "p", "slots": 1}]),
        "log": make("log", [{"dttm": DAY}]),
        "serialized_dag": make("serialized_dag", [{"dag_id": "d", "data": "{}", "dag_hash": f"h{i}", "last_updated": DAY} for i in range(4)]),
        "table_sizes": make("table_sizes", [{"schemaname": "public", "tablename": "t", "total_size_bytes": 2 * 10**9, "table_size_bytes": 10**9}]),
        "index_usage": make("index_usage", [{"schemaname": "public", "tablename": "t", "indexname": "i", "index_scans": 0, "index_size_bytes": 10**8}]),
        "activity": make("activity", [{"pid": i, "state": "active", "query_start": DAY, "backend_start": DAY} for i in range(15)]),
        "locks": make("locks", [{"pid": i, "locktype": "l", "mode": "m", "granted": False} for i in range(6)]),
        "settings": make("settings", [{**setting, "setting": "dagbag_import_timeout", "value": "60"}]),
        "file_inventory": make("file_inventory", [{"path": "a.csv", "size_bytes": 11 * 1048576}]),
    }


def test_numbers_are_those_of_all_rows(spark, make):
    """More failing tasks, queued workflows and stuck tasks than any display limit."""
    start = DAY + timedelta(hours=1)
    given = {
        "task_fail": make("task_fail", [{"dag_id": f"d{i % 3}", "task_id": f"t{i}", "start_date": DAY} for i in range(70)]),
        "dag_run": make("dag_run", [
            {"dag_id": f"w{i % 45}", "run_id": str(i), "state": "queued", "execution_date": None if i % 5 == 0 else DAY} for i in range(90)
        ]),
        "task_instance": make("task_instance", [
            {"dag_id": f"d{i}", "task_id": "t", "run_id": "r", "state": "running", "start_date": start} for i in range(64)
        ]),
        "table_sizes": make("table_sizes", [
            {"schemaname": "public", "tablename": f"t{i}", "total_size_bytes": 2 * 10**9, "table_size_bytes": 1} for i in range(33)
        ]),
    }
    names = {"task_failures", "catchup_backlog", "zombie_tasks", "storage_footprint"}

    def run(settings):
        results = diagnostics.run_diagnostics(given, settings, only=names)
        found = findings.findings(results, settings)
        numbers = recommendations.headline_numbers(results, found)
        values = {r["code"]: r["value"] for r in found.collect()} | {r["metric"]: r["value"] for r in numbers.collect()}
        return results, found, recommendations.recommendations(numbers, settings), values

    results, found, advice, values = run(SETTINGS)
    wanted = ["failing_tasks", "queued_runs", "catchup_backlog", "zombie_tasks", "large_tables"]
    assert [values[w] for w in wanted] == [70, 90, 45, 64, 33]
    assert "Clear the backlog of 90 queued runs" in [r["recommendation"] for r in advice.collect()]
    totals = failures.failures_by_dag(results["task_failures"])
    assert [r["total_failures"] for r in totals.collect()] == [24, 23, 23]
    few, every = (report.report_lines(results, found, advice, rows_per_section=n) for n in (5, None))
    assert few.where("section = 1").count() == 6 and every.where("section = 1").count() == 46
    cut = run(diagnostics.Settings(as_of=NOW, cut=True))[3]
    assert [cut[w] for w in wanted] == [50, 60, 30, 50, 20]


def test_whole_run(spark, tables, tmp_path):
    results = diagnostics.run_diagnostics(tables, SETTINGS, settle=True)
    assert len(results) == len(diagnostics.steps(SETTINGS)) + 2
    found = settle.settled(findings.findings(results, SETTINGS))
    codes = {(r["domain"], r["severity"], r["code"]): r["message"] for r in found.collect()}
    assert codes[("errors", "critical", "frequent_errors")] == "1 tasks fail with high frequency"
    assert codes[("scheduler", "critical", "possible_hang")] == "1 scheduler hosts had a heartbeat gap over 300 s"
    assert codes[("database", "critical", "pool_exhausted")] == "connection pool is 100 percent used"
    expected = {
        ("errors", "critical", "failure_cascades"), ("timing", "critical", "catchup_backlog"), ("timing", "warning", "sla_misses"),
        ("execution", "critical", "zombie_tasks"), ("execution", "warning", "pools_overused"), ("database", "critical", "many_lock_waits"),
        ("database", "warning", "large_tables"), ("database", "info", "large_unused_indexes"), ("scheduler", "warning", "slow_loop"),
    }
    assert expected <= set(codes)
    assert ("scheduler", "warning", "slow_heartbeat") not in codes

    numbers = settle.settled(recommendations.headline_numbers(results, found))
    advice = recommendations.recommendations(numbers, SETTINGS)
    lines = {r["rule_no"]: r["recommendation"] for r in advice.collect()}
    assert lines[8] == "Investigate failing runs, the success rate is 81.8 percent"
    assert lines[9] == "Review 12 failing tasks"
    assert lines[31] == "Move data files of 11.00 MB out of the workflow folder"
    assert {1, 2, 4, 10, 19, 28, 29} <= set(lines) and not {5, 6, 7, 16, 23, 30} & set(lines)
    assert [r["position"] for r in advice.collect()] == list(range(1, len(lines) + 1))

    health = runs.run_health_status(results["run_performance"])
    row = report.report_summary(numbers, health, found, advice).first()
    assert (row["total_dags"], row["performance_issues"], row["failing_tasks"], row["unstable_dags"]) == (4, 1, 12, 1)
    assert (row["config_changed"], row["recommendations_count"], row["peak_concurrent_dags"]) == (False, len(lines), 10)

    text = report.report_lines(results, found, advice)
    path = report.report_path(str(tmp_path / "diag"), "prod", "full", datetime(2024, 1, 8))
    assert path.endswith("diag/prod/2024-01-08/full_20240108T000000.txt")
    report.write_report(text, path)
    (file,) = glob.glob(f"{path}/part-*.txt")
    written = open(file).read().splitlines()
    assert written[0] == "RUN PERFORMANCE" and all(title in written for title, *_ in report.SECTIONS)
    assert written[1] == f"{'d':<35} {11:8d} runs {81.82:6.2f} % {'5.0m':>10}"
    assert written.index("FINDINGS") < written.index("RECOMMENDATIONS")
    assert written[-1] == f"{len(lines)}. {lines[max(lines)]}"


def test_every_result_has_a_section():
    shown = [name for _, name, *_ in report.SECTIONS]
    known = set(diagnostics.steps(SETTINGS)) | {"table_row_counts", "table_growth"}
    assert len(shown) == len(set(shown)) and set(shown) == known - {"peak_and_quiet_hours"}


def test_missing_tables_are_skipped(tables):
    results = diagnostics.run_diagnostics({"job": tables["job"]}, SETTINGS)
    assert set(results) == {"heartbeat_gaps", "loop_duration", "table_row_counts"} | ({"table_growth"} & set(results))
    with pytest.raises(ValueError):
        findings.findings({}, SETTINGS)


def test_few_results_read_the_tables_without_keeping_them(tables, monkeypatch):
    kept = []
    for name in ("recent_tasks", "recent_runs"):
        monkeypatch.setattr(diagnostics, name, lambda df, s, name=name: kept.append(name) or df)
    names = {"error_clusters", "zombie_tasks", "catchup_backlog"}
    results = diagnostics.run_diagnostics(tables, SETTINGS, only=names, settle=True)
    assert set(results) == names and kept == []


def test_settled_and_lazy_agree(tables):
    names = {"task_concurrency", "task_duration_trends", "zombie_tasks", "catchup_backlog", "run_concurrency", "queued_duration"}
    lazy = diagnostics.run_diagnostics(tables, SETTINGS, only=names)
    kept = diagnostics.run_diagnostics(tables, SETTINGS, only=names, settle=True)
    for name in names:
        assert as_dicts(lazy[name]) == as_dicts(kept[name]), name


def test_all_is_well(spark):
    numbers = spark.createDataFrame([("avg_success_rate", 99.0)], "metric string, value double")
    assert as_dicts(recommendations.recommendations(numbers, SETTINGS)) == [
        {"position": 1, "rule_no": 0, "recommendation": "All checks passed, keep monitoring"}
    ]


@pytest.mark.parametrize(
    ("result", "schema", "row", "codes"),
    [
        ("queue_depth", "max_queued long, avg_queued double", (100, 20.0), {"queue_deep"}),
        ("queue_depth", "max_queued long, avg_queued double", (101, 20.1), {"queue_very_deep", "queue_always_deep"}),
        ("queue_depth", "max_queued long, avg_queued double", (50, 1.0), set()),
        ("capacity_forecast", "current_avg_daily_tasks double, tasks_growth_per_day double", (314.4, 10.1), {"capacity_near"}),
        ("capacity_forecast", "current_avg_daily_tasks double, tasks_growth_per_day double", (314.4, 10.0), {"capacity_in_sight"}),
        ("capacity_forecast", "current_avg_daily_tasks double, tasks_growth_per_day double", (900.0, 5.0), set()),
        ("capacity_forecast", "current_avg_daily_tasks double, tasks_growth_per_day double", (1.0, -10.5), {"workload_shrinking"}),
        ("connection_stats", "total_connections long, idle_in_transaction long", (12, 6), {"pool_busy", "idle_transactions"}),
        ("run_concurrency", "max_concurrent_dags long, p95_concurrent_dags double", (13, 9.6), {"run_limit_near"}),
        ("run_concurrency", "max_concurrent_dags long, p95_concurrent_dags double", (None, None), set()),
        ("task_concurrency", "max_concurrent_tasks long, avg_concurrent_tasks double", (28, 2.0), {"parallelism_near"}),
        ("task_concurrency", "max_concurrent_tasks long, avg_concurrent_tasks double", (24, 9.5), {"parallelism_unused"}),
        ("table_growth", "table_name string, current_rows long, rows_per_day double", ("task_instance", 9_800_000, 10_001.0), {"task_rows_growing"}),
        ("table_row_counts", "table_name string, row_count long", ("task_instance", 5_000_001), {"task_rows"}),
        ("failure_prediction", "dag_id string, task_id string, failure_trend string, failure_rate double, recent_failures long, old_failures long", ("d", "t", "High", 30.1, 1, 1), {"high_risk_tasks"}),
        ("error_correlation", "co_occurrence_count long", (3,), set()),
    ],
)
def test_finding_limits(spark, result, schema, row, codes):
    df = spark.createDataFrame([row], schema)
    assert {r["code"] for r in findings.findings({result: df}, SETTINGS).collect()} == codes


def test_checkpoint_folder_follows_the_session(spark):
    folder = settle.ensure_checkpoint_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir() == settle.ensure_checkpoint_dir(spark)
