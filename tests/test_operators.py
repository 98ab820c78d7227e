"""Boundary rows of the run, task, failure and forecast operators."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from runscope.operators import failures, forecast, runs, scheduler, tasks

from .conftest import as_dicts

NOW = "2024-01-08 00:00:00"
DAY = datetime(2024, 1, 5)


def ti(i: int, seconds: float | None = 60, *, dag="d", task="t", state="success", day=DAY, **more) -> dict:
    start = day + timedelta(minutes=i)
    end = None if seconds is None else start + timedelta(seconds=seconds)
    row = {"dag_id": dag, "task_id": task, "run_id": f"r{i}", "state": state, "try_number": 1}
    return {**row, "execution_date": day, "start_date": start, "end_date": end, **more}


def run(state="success", *, dag="d", execution="2024-01-05 00:00:00", lag=0, seconds=60, **more) -> dict:
    at = datetime.fromisoformat(execution)
    start = at + timedelta(seconds=lag)
    row = {"dag_id": dag, "run_id": "r", "state": state, "execution_date": at, "start_date": start}
    return {**row, "end_date": start + timedelta(seconds=seconds), **more}


def test_window_bounds(make):
    rows = [
        run(execution="2023-12-31 23:59:59"),
        run(execution="2024-01-01 00:00:00"),
        run(execution="2024-01-07 23:59:59"),
        run(execution="2024-01-08 00:00:00"),
    ]
    assert runs.run_performance(make("dag_run", rows), as_of=NOW).first()["total_runs"] == 2
    # the window starts at midnight whatever the hour of as_of
    assert runs.run_performance(make("dag_run", rows), as_of="2024-01-07 18:00:00").first()["total_runs"] == 2


def test_performance_with_missing_times(make):
    rows = [run(seconds=30), run("failed", seconds=90), run("running", end_date=None), run("queued", start_date=None)]
    row = runs.run_performance(make("dag_run", rows), as_of=NOW).first()
    assert (row["success_rate_percent"], row["avg_runtime_seconds"], row["running_runs"], row["queued_runs"]) == (25.0, 60.0, 1, 1)


@pytest.mark.parametrize(
    ("good", "bad", "seconds", "status", "issues"),
    [
        (95, 5, 60, "Warning", []),
        (94, 6, 60, "Critical", ["LOW_SUCCESS_RATE"]),
        (98, 2, 60, "Healthy", []),
        (97, 3, 3601, "Warning", ["LONG_RUNTIME"]),
        (100, 0, 3600, "Healthy", []),
        (100, 0, 3601, "Warning", ["LONG_RUNTIME"]),
        (90, 10, 3601, "Critical", ["LOW_SUCCESS_RATE", "LONG_RUNTIME"]),
    ],
)
def test_health_limits(make, good, bad, seconds, status, issues):
    rows = [run(seconds=seconds)] * good + [run("failed", seconds=seconds)] * bad
    row = runs.run_health_status(runs.run_performance(make("dag_run", rows), as_of=NOW)).first()
    assert (row["status"], row["issues"]) == (status, issues)


def test_success_histogram_shows_empty_buckets(spark):
    rates = spark.createDataFrame([("a", 49.99), ("b", 50.0), ("c", 95.0), ("d", None)], "dag_id string, success_rate_percent double")
    assert {r["bucket"]: r["dags"] for r in runs.success_rate_histogram(rates).collect()} == {
        "<50%": 1, "50-80%": 1, "80-95%": 0, "95-100%": 1
    }


def test_quiet_hours_running_and_global(spark):
    hourly = spark.createDataFrame([(0, 5), (1, 100), (2, 9), (3, 10), (4, 0)], "hour_of_day int, total_runs long")

    def quiet(mode):
        return [r["hour_of_day"] for r in runs.peak_and_quiet_hours(hourly, mode=mode).collect() if r["is_quiet"]]

    assert quiet("running") == [2]
    assert quiet("global") == [0, 2]
    assert [r["hour_of_day"] for r in runs.peak_and_quiet_hours(hourly).collect() if r["is_peak"]] == [1]
    with pytest.raises(ValueError):
        runs.peak_and_quiet_hours(hourly, mode="other")


def test_frequency_needs_two_runs(make):
    rows = [run(dag="one"), run(dag="two", seconds=10), run(dag="two", seconds=100, execution="2024-01-06 12:00:00")]
    got = as_dicts(runs.dag_frequency(make("dag_run", rows), as_of=NOW))
    assert [(r["dag_id"], r["avg_runs_per_day"], r["duration_variance"], r["time_span_hours"]) for r in got] == [
        ("two", 1.0, "High Variance", 36.0)
    ]


def test_drift_and_delay_limits(make):
    rows = [run(dag="at", lag=60), run(dag="over", lag=61), run(dag="late", lag=301), run(dag="late", lag=3601)]
    rows += [run(dag="waits", lag=500, state="queued")]
    got = as_dicts(runs.schedule_drift(make("dag_run", rows), as_of=NOW))
    assert [(r["dag_id"], r["runs_delayed_5min"], r["runs_delayed_1hour"]) for r in got] == [("late", 2, 1), ("over", 0, 0)]
    assert got[1]["stddev_drift_seconds"] is None
    delay = {r["dag_id"]: r for r in runs.scheduling_delay(make("dag_run", rows), as_of=NOW).collect()}
    assert set(delay) == {"at", "over", "late", "waits"} and delay["late"]["median_lag_seconds"] == 1951.0
    assert delay["late"]["pct_delayed_5min"] == 100.0


def test_limit_cuts_ties_by_key(make):
    rows = [run(dag=f"d{i}", lag=100) for i in range(5)]
    got = [r["dag_id"] for r in runs.schedule_drift(make("dag_run", rows), as_of=NOW, limit=3).collect()]
    assert got == ["d0", "d1", "d2"]
    assert runs.schedule_drift(make("dag_run", rows), as_of=NOW, limit=None).count() == 5


def test_backlog_has_no_window(make):
    rows = [run("queued", execution="2020-01-01 00:00:00"), run("queued", execution="2024-01-07 00:00:00"), run()]
    row = runs.catchup_backlog(make("dag_run", rows), as_of=NOW).first()
    assert (row["queued_runs"], row["oldest_run_age_hours"]) == (2, 1468 * 24.0)


def test_utilisation_labels(spark):
    def labels(peak_runs, p95, peak_tasks, avg_tasks):
        r = spark.createDataFrame([(peak_runs, 1.0, p95, 1.0)], "max_concurrent_dags long, avg_concurrent_dags double, p95_concurrent_dags double, p99_concurrent_dags double")
        t = spark.createDataFrame([(peak_tasks, avg_tasks, 1.0, 1.0, 5)], "max_concurrent_tasks long, avg_concurrent_tasks double, p95_concurrent_tasks double, p99_concurrent_tasks double, sample_points long")
        return [x["label"] for x in runs.utilisation_vs_limit(r, t).orderBy("scope").collect()]

    assert labels(13, 1.0, 29, 20.0) == ["Peak near limit", "Over 90%"]
    assert labels(12, 10.0, 25, 20.0) == ["P95 high", "Over 75%"]
    assert labels(1, 1.0, 24, 9.5) == ["Normal", "Under 30%"]
    assert labels(1, 1.0, 24, 9.6) == ["Normal", "Normal"]


def halves(old: list[float], recent: list[float]) -> list[dict]:
    # with 7 days the recent part starts on 2024-01-05
    return [ti(i, s, day=datetime(2024, 1, 4)) for i, s in enumerate(old)] + [ti(i, s) for i, s in enumerate(recent)]


@pytest.mark.parametrize(
    ("recent", "change", "status"),
    [(120, 20.0, "Stable"), (121, 21.0, "Slower"), (150, 50.0, "Slower"), (151, 51.0, "Degrading"), (80, -20.0, "Stable"), (79, -21.0, "Improved")],
)
def test_trend_labels(make, recent, change, status):
    rows = make("task_instance", halves([100] * 3, [recent] * 3))
    row = tasks.duration_trend_status(tasks.task_duration_trends(rows, as_of=NOW)).first()
    assert (row["duration_change_percent"], row["status"]) == (change, status)


def test_trend_filters(make):
    def count(rows):
        return tasks.task_duration_trends(make("task_instance", rows), as_of=NOW).count()

    assert count(halves([100] * 2, [100] * 2)) == 0  # four rows
    assert count(halves([100] * 2, [100] * 3)) == 1
    assert count(halves([], [100] * 6)) == 0  # nothing old
    assert count(halves([0, -5, 100], [100, 100, 100])) == 0  # no or negative duration
    assert count([{**r, "end_date": None} for r in halves([100] * 3, [100] * 3)]) == 0


def test_retries(make):
    rows = [ti(0, try_number=1), ti(1, try_number=2, state="failed"), ti(1, try_number=3), ti(0, task="calm")]
    got = as_dicts(tasks.task_retry_patterns(make("task_instance", rows), as_of=NOW))
    assert len(got) == 1
    assert (got[0]["retry_rate_percent"], got[0]["failure_rate_percent"], got[0]["max_retries"]) == (66.67, 50.0, 3)


def test_queue_lag_and_wait(make):
    def wait(i, seconds, **more):
        row = ti(i, **more)
        return {**row, "queued_dttm": row["start_date"] - timedelta(seconds=seconds)}

    rows = [wait(i, 10 * i) for i in range(5)] + [wait(6, -1)] + [wait(i, 50, task="four") for i in range(4)]
    rows += [ti(7)] + [wait(8, 1000, state="queued")]
    table = make("task_instance", rows)
    lag = as_dicts(tasks.executor_queue_lag(table, as_of=NOW))
    assert [(r["task_id"], r["task_count"], r["p95_queue_lag_seconds"]) for r in lag] == [("t", 5, 38.0)]
    waits = {r["task_id"]: r for r in tasks.queued_duration(table, as_of=NOW).collect()}
    assert (waits["t"]["task_count"], waits["t"]["queued_over_5min"], waits["four"]["median_queue_seconds"]) == (6, 1, 50.0)


def test_pools(make):
    rows = [ti(0, pool="p", state="running"), ti(1, pool="p", state="running"), ti(0, pool="lost"), ti(0, pool="zero", state="running")]
    rows += [ti(0, pool="default_pool"), ti(0, pool=None), ti(120, pool="p")]
    slots = make("slot_pool", [{"pool": "p", "slots": 2}, {"pool": "zero", "slots": 0}])
    use = tasks.pool_utilisation(make("task_instance", rows), slots, as_of=NOW)
    got = {r["pool"]: r for r in use.collect()}
    assert set(got) == {"p", "lost", "zero"}
    assert (got["p"]["avg_utilization_percent"], got["p"]["peak_utilization_percent"], got["p"]["active_hours"]) == (50.0, 100.0, 2)
    assert got["lost"]["pool_slots"] is None and got["zero"]["peak_utilization_percent"] is None
    status = {r["pool"]: r["status"] for r in tasks.pool_utilisation_status(use).collect()}
    assert status == {"p": "Overutilized", "lost": "Underutilized", "zero": "Underutilized"}


def test_zombies(make):
    rows = [ti(0, None, state="running", day=datetime(2024, 1, 7, 18)), ti(1, None, state="running", day=datetime(2024, 1, 7, 17)), ti(0)]
    got = as_dicts(tasks.zombie_tasks(make("task_instance", rows), as_of=NOW))
    assert [round(r["hours_running"], 2) for r in got] == [6.98]


def test_variance_needs_five_and_zero_mean_is_safe(make):
    rows = [ti(i, s) for i, s in enumerate([10, 20, 30, 40, 50])] + [ti(i, 5, task="four") for i in range(4)]
    got = as_dicts(tasks.execution_variance(make("task_instance", rows), as_of=NOW))
    assert [(r["task_id"], r["coefficient_of_variation"], r["range_ratio"]) for r in got] == [("t", 52.7, 1.33)]


def test_sla_and_failures(make):
    sla = [{"dag_id": "d", "task_id": "t", "execution_date": "2024-01-05 00:00:00", "timestamp": f"2024-01-0{d} 00:10:00"} for d in (5, 6)]
    row = tasks.sla_miss_patterns(make("sla_miss", sla), as_of=NOW).first()
    assert (row["sla_miss_count"], row["days_with_misses"], row["avg_delay_seconds"]) == (2, 2, 43800.0)
    fails = [{"dag_id": f"d{i % 2}", "task_id": f"t{i}", "start_date": "2024-01-05 00:00:00"} for i in range(6)]
    counted = failures.task_failures(make("task_fail", fails), as_of=NOW)
    assert counted.first()["avg_failure_duration_seconds"] is None
    assert [(r["dag_id"], r["total_failures"]) for r in failures.failures_by_dag(counted, top_n=3).collect()] == [("d0", 3)]


@pytest.mark.parametrize(("n", "label"), [(10, "Low"), (11, "Medium"), (20, "Medium"), (21, "High"), (50, "High"), (51, "Very High")])
def test_cluster_labels(make, n, label):
    rows = [ti(i, state="failed") for i in range(n)]
    assert failures.error_clusters(make("task_instance", rows), as_of=NOW).first()["frequency_category"] == label


def test_transient_labels(make):
    def row(good, bad):
        rows = [ti(i, try_number=2) for i in range(good)] + [ti(100 + i, try_number=2, state="failed") for i in range(bad)]
        return failures.transient_vs_persistent(make("task_instance", rows + [ti(500)]), as_of=NOW).first()

    assert row(2, 2) is None
    assert row(9, 1)["failure_type"] == "Transient"
    assert row(8, 2)["failure_type"] == "Mixed"
    assert row(3, 3)["failure_type"] == "Persistent"
    assert row(3, 3)["retry_runs"] == 6  # the first try is not seen


def test_cascades(make):
    rows = [ti(0, task=f"t{i}", state="failed", run_id="a") for i in range(3)]
    rows += [ti(0, task="t0", state="failed", run_id="a")] + [ti(0, task=f"t{i}", state="failed", run_id="b") for i in range(2)]
    row = failures.failure_cascades(make("task_instance", rows), as_of=NOW).first()
    assert (row["cascade_count"], row["avg_tasks_per_cascade"], row["avg_cascade_duration_seconds"]) == (1, 3.0, 0)


def test_prediction(make):
    old, new = datetime(2024, 1, 4), DAY

    def rows(task, old_bad, new_bad, good):
        out = [ti(i, task=task, state="failed", day=old) for i in range(old_bad)]
        out += [ti(i, task=task, state="failed", day=new) for i in range(new_bad)]
        return out + [ti(i, task=task) for i in range(good)]

    table = make("task_instance", rows("up", 0, 3, 7) + rows("down", 2, 1, 20) + rows("same", 2, 2, 10) + rows("calm", 0, 0, 5))
    got = {r["task_id"]: r for r in forecast.failure_prediction(table, as_of=NOW).collect()}
    assert {k: r["failure_trend"] for k, r in got.items()} == {"up": "Increasing", "down": "Decreasing", "same": "High"}
    assert got["up"]["trend_change_percent"] is None and got["down"]["trend_change_percent"] == -50.0
    risk = {r["task_id"]: r["risk_level"] for r in forecast.failure_risk_level(forecast.failure_prediction(table, as_of=NOW)).collect()}
    assert risk == {"up": "Critical", "down": "Low", "same": "Medium"}


def test_capacity(spark, make):
    rows = [ti(i, 60, day=datetime(2024, 1, d)) for d in range(1, 6) for i in range(10 * d)]
    grown = forecast.capacity_forecast(make("task_instance", rows), as_of=NOW)
    assert (grown.first()["current_avg_daily_tasks"], grown.first()["tasks_growth_per_day"]) == (30.0, 10.0)
    left = forecast.days_to_capacity(grown).first()
    assert (left["days_to_80_percent"], left["label"]) == (58.44, "Warning")
    shrinking = spark.createDataFrame([(900.0, -10.1)], "current_avg_daily_tasks double, tasks_growth_per_day double")
    assert forecast.days_to_capacity(shrinking).first()["label"] == "Decreasing"


@pytest.mark.parametrize(("weeks", "found"), [(2, 0), (3, 1)])
def test_degradation_needs_three_weeks(make, weeks, found):
    rows = [ti(i, 100 + 10 * w, day=datetime(2024, 1, 1) - timedelta(weeks=w)) for w in range(weeks) for i in range(3)]
    slower = [{**r, "end_date": r["start_date"] + timedelta(seconds=200 - (r["end_date"] - r["start_date"]).seconds)} for r in rows]
    got = as_dicts(forecast.performance_degradation(make("task_instance", slower), as_of=NOW, analysis_days=60))
    assert len(got) == found
    if found:
        assert (got[0]["duration_increase_per_week"], got[0]["performance_trend"]) == (10.0, "Degrading")


@pytest.mark.parametrize(("normal", "found"), [(8, 0), (9, 0), (10, 1)])
def test_anomalies_need_eleven_rows(make, normal, found):
    rows = [ti(i, 100) for i in range(normal)] + [ti(99, 10_000)]
    got = as_dicts(forecast.anomaly_detection(make("task_instance", rows), as_of=NOW))
    assert len(got) == found
    if found:
        assert (got[0]["anomaly_count"], got[0]["avg_anomaly_duration"], got[0]["max_z_score"]) == (1, 10000.0, 3.02)


def test_constant_durations_have_no_anomaly(make):
    assert forecast.anomaly_detection(make("task_instance", [ti(i, 100) for i in range(20)]), as_of=NOW).count() == 0


def test_seasons_name_days(make):
    got = as_dicts(forecast.seasonal_patterns(make("task_instance", [ti(0), ti(1), ti(70)]), as_of=NOW))
    assert [(r["day_of_week"], r["day_name"], r["max_executions"], r["coefficient_of_variation"]) for r in got] == [(5, "Friday", 2, 47.14)]


def test_heartbeats(make):
    beats = [0, 30, 30, 100, 500]
    rows = [{"hostname": "h", "job_type": "SchedulerJob", "latest_heartbeat": DAY + timedelta(seconds=s)} for s in beats]
    rows += [{"hostname": "h", "job_type": "TriggererJob", "latest_heartbeat": DAY}]
    rows += [{"hostname": "lone", "job_type": "SchedulerJob", "latest_heartbeat": DAY}]
    job = make("job", rows)
    gaps = scheduler.heartbeat_gaps(job, as_of=NOW)
    got = as_dicts(gaps)
    assert [(r["hostname"], r["heartbeat_count"], r["max_gap_seconds"], r["gaps_over_1min"]) for r in got] == [("h", 4, 400.0, 2)]
    assert scheduler.heartbeat_status(gaps).first()["status"] == "Possible hang"
    assert scheduler.loop_duration(job, as_of=NOW).first()["loop_count"] == 3


def test_growth_and_limits(spark):
    growth = spark.createDataFrame([("task_instance", 9_800_000, 10_001.0), ("log", 5, 10_000.0)], "table_name string, current_rows long, rows_per_day double")
    got = {r["table_name"]: (r["days_to_limit"], r["is_alert"]) for r in forecast.days_to_row_limit(growth).collect()}
    assert got == {"task_instance": (20.0, True), "log": (None, False)}
    counts = spark.createDataFrame([("task_instance", 10_000_001), ("log", 1_000_001), ("xcom", 1_000_000), ("dag_run", 10**9)], "table_name string, row_count long")
    assert {r["table_name"]: r["status"] for r in forecast.table_size_status(counts).collect()} == {
        "task_instance": "Critical", "log": "Warning", "xcom": "Normal", "dag_run": "Normal"
    }
    with pytest.raises(ValueError):
        forecast.table_row_counts({})
