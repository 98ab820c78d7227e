"""Windows from stored day states against the same windows from rows."""

from __future__ import annotations

import glob
import random
from datetime import date, datetime, timedelta

import pytest

from runscope.operators import daystates as s
from runscope.operators import forecast, runs, tasks

FIRST, DAYS = date(2024, 1, 1), 12


def rows(seed=4, n=3000):
    rng = random.Random(seed)
    for _ in range(n):
        planned = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(DAYS * 86_400))
        start = planned + timedelta(seconds=rng.randrange(0, 4000))
        end = None if rng.random() < 0.1 else start + timedelta(seconds=rng.choice([0, 5, rng.lognormvariate(4, 1.5)]))
        yield {
            "dag_id": rng.choice(["a", "b", "c", None]), "task_id": rng.choice(["x", "y"]), "run_id": "r",
            "state": rng.choice(["success"] * 5 + ["failed", "running", "queued", None]),
            "execution_date": None if rng.random() < 0.01 else str(planned), "start_date": str(start), "end_date": end and str(end),
        }


@pytest.fixture(scope="module")
def made(spark, make, tmp_path_factory):
    """(dag_run, task_instance, states of both), the states written day by day."""
    folder = tmp_path_factory.mktemp("days")
    given = list(rows())
    out = []
    for name, states in (("dag_run", s.run_states), ("task_instance", s.task_states)):
        source = f"{folder}/{name}"
        make(name, given).write.parquet(source)
        table = spark.read.parquet(source)
        for i in range(DAYS + 1):
            s.add_day(table, states, FIRST + timedelta(days=i), f"{folder}/{name}-states")
        out += [table, s.stored_states(spark, f"{folder}/{name}-states")]
    return out[0], out[2], out[1], out[3]


def same(found, wanted):
    found, wanted = ([r.asDict() for r in df.collect()] for df in (found, wanted))
    key = lambda r: str([r.get(k) for k in ("dag_id", "task_id", "hour_of_day")])
    assert len(found) == len(wanted) > 0 and list(found[0]) == list(wanted[0])
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key)):
        for c in a:
            if isinstance(b[c], float):
                assert a[c] == pytest.approx(b[c], rel=1e-9, abs=0.011), c
            else:
                assert a[c] == b[c], c


@pytest.mark.parametrize(("last", "days"), [(13, 12), (10, 7), (9, 1), (12, 3)])
def test_windows_from_states(made, last, days):
    dag_run, task_instance, run, task = made
    day = date(2024, 1, last)
    old, new = {"as_of": day.isoformat(), "analysis_days": days}, {"as_of": day, "analysis_days": days}
    same(s.run_performance_from_states(run, **new), runs.run_performance(dag_run, **old))
    same(s.hourly_traffic_from_states(run, **new), runs.hourly_traffic(dag_run, **old))
    same(s.dag_frequency_from_states(run, **new), runs.dag_frequency(dag_run, **old))
    same(s.capacity_forecast_from_states(task, **new), forecast.capacity_forecast(task_instance, **old))
    if days > 1:
        found = s.task_duration_trends_from_states(task, **new, limit=None)
        wanted = tasks.task_duration_trends(task_instance, **old, limit=None, approximate=s.STORED_ERROR)
        same(found, wanted)  # sketches of so few values hold all of them


def test_a_day_is_read_and_written_alone(spark, made, tmp_path):
    dag_run = made[0]
    path = str(tmp_path / "states")
    for day in (3, 4):
        s.add_day(dag_run, s.run_states, date(2024, 1, day), path)
    before = {f: open(f, "rb").read() for f in glob.glob(f"{path}/day=2024-01-03/*.parquet")}
    read = s.add_day(dag_run, s.run_states, date(2024, 1, 4), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = read._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(execution_date,2024-01-04" in plan and "LessThan(execution_date,2024-01-05" in plan
    assert before == {f: open(f, "rb").read() for f in glob.glob(f"{path}/day=2024-01-03/*.parquet")}
    stored = s.stored_states(dag_run.sparkSession, path)
    assert {r.day for r in stored.select("day").distinct().collect()} == {date(2024, 1, 3), date(2024, 1, 4)}
    # the second run of a day replaced the first
    assert stored.where("day = DATE'2024-01-04'").agg({"runs": "sum"}).first()[0] == read.count()


def test_windows_read_only_their_days(made):
    window = s.run_performance_from_states(made[2], as_of=date(2024, 1, 10), analysis_days=2)
    assert "PartitionFilters: [isnotnull(day" in window._jdf.queryExecution().executedPlan().toString()
