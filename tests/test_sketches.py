"""Approximate percentiles and distinct counts against the exact ones."""

from __future__ import annotations

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runscope.functions import sketches
from runscope.functions.scale import exact_percentiles
from runscope.operators import runs, tasks

T0 = datetime(2024, 1, 20)
WANTED = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


def values(n=60_000, seed=3):
    rng = random.Random(seed)
    return [("hot" if i % 3 else f"k{i % 30}", rng.choice([0.0, rng.lognormvariate(2, 2), rng.uniform(-9, 9)]), i % 5) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(values(), "k string, v double, day int").repartition(6)


def off(held: list[float], x: float, share: float) -> float:
    """How far ``share`` lies outside the ranks of ``x``, as a share of the values."""
    low, high = bisect.bisect_left(held, x) / len(held), bisect.bisect_right(held, x) / len(held)
    return max(0.0, low - share, share - high)


@pytest.mark.parametrize("error", [0.05, 0.01])
def test_rank_error(table, error):
    by_key: dict = {}
    for k, v, _ in values():
        by_key.setdefault(k, []).append(v)
    exact = {r.k: r for r in exact_percentiles(table, ["k"], "v", WANTED).collect()}
    whole = sketches.percentiles_of(sketches.percentile_sketches(table, ["k"], "v", error), ["k"], WANTED)
    daily = sketches.percentiles_of(sketches.percentile_sketches(table, ["k", "day"], "v", error), ["k"], WANTED)
    for found in (whole.collect(), daily.collect()):  # at once, and merged from a sketch for each day
        assert {r.k for r in found} == set(exact)
        for r in found:
            held = sorted(by_key[r.k])
            for name, share in WANTED.items():
                assert off(held, r[name], share) <= error, (r.k, name)
                assert off(held, exact[r.k][name], share) <= 1 / len(held)


def test_small_groups_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 7.0)], "k string, v double")
    found = sketches.percentiles_of(sketches.percentile_sketches(df, ["k"], "v", 0.01), ["k"], {"p50": 0.5})
    assert {r.k: r.p50 for r in found.collect()} == {"a": 1.0, "b": None, None: 7.0}


@pytest.mark.parametrize("error", [0.05, 0.01])
def test_distinct_error(table, error):
    ids = table.withColumn("id", F.concat("k", F.round("v", 2).cast("string")))
    exact = ids.agg(sketches.distinct_count("id").alias("n")).first().n
    near = ids.agg(sketches.distinct_count("id", error).alias("n")).first().n
    by_day = ids.groupBy("day").agg(sketches.distinct_sketch("id", error).alias("s"))
    merged = by_day.agg(sketches.merged_distinct("s").alias("n")).first().n
    assert exact > 10_000 and abs(near - exact) <= 3 * error * exact and abs(merged - exact) <= 3 * error * exact
    assert ids.limit(0).agg(sketches.distinct_count("id", error).alias("n")).first().n == 0


def test_sizes_and_errors():
    assert sketches.quantile_size(0.5) == 8 and sketches.quantile_size(0.01) < sketches.quantile_size(0.001) <= 65_535
    assert sketches.distinct_size(0.9) == 4 and sketches.distinct_size(0.01) == 14
    for bad in (0, 1, -0.1):
        with pytest.raises(ValueError):
            sketches.quantile_size(bad)
        with pytest.raises(ValueError):
            sketches.distinct_size(bad)


def many_tasks(make, table, n=4000):
    rng, rows = random.Random(8), []
    for i in range(n):
        planned = T0 + timedelta(minutes=rng.randrange(14 * 1440))
        queued = planned + timedelta(seconds=rng.lognormvariate(4, 1))
        start = queued + timedelta(seconds=rng.lognormvariate(4, 1))
        end = start + timedelta(seconds=rng.lognormvariate(5, 1))
        rows.append({
            "dag_id": f"d{i % 3}", "task_id": "t", "run_id": f"r{i // 2}", "state": "running" if i % 4 == 0 else "success", "try_number": 1 + i % 2,
            "execution_date": str(planned), "queued_dttm": str(queued), "start_date": str(start), "end_date": str(end),
        })
    return make(table, rows)


PERCENTILES = [
    (runs.schedule_drift, "dag_run", ["p95_drift_seconds"]),
    (runs.scheduling_delay, "dag_run", ["median_lag_seconds", "p95_lag_seconds"]),
    (runs.run_concurrency, "dag_run", ["p95_concurrent_dags", "p99_concurrent_dags"]),
    (runs.task_concurrency, "task_instance", ["p95_concurrent_tasks", "p99_concurrent_tasks"]),
    (tasks.task_duration_trends, "task_instance", ["median_duration_seconds", "p95_duration_seconds"]),
    (tasks.executor_queue_lag, "task_instance", ["p95_queue_lag_seconds"]),
    (tasks.queued_duration, "task_instance", ["median_queue_seconds", "p95_queue_seconds"]),
]


@pytest.mark.parametrize(("operator", "source", "marks"), PERCENTILES)
def test_operators_with_the_option(make, operator, source, marks):
    """Only the percentiles differ, and they by little; the default stays exact."""
    df = many_tasks(make, source)
    options = {"as_of": "2024-02-04", "analysis_days": 20}
    exact, near = operator(df, **options).collect(), operator(df, **options, approximate=0.002).collect()
    assert len(exact) == len(near) > 0
    for a, b in zip(exact, near):
        for c in a.asDict():
            if c in marks:
                assert b[c] == pytest.approx(a[c], rel=0.1)
            else:
                assert a[c] == b[c] or a[c] == pytest.approx(b[c])


def test_sketches_take_one_pass(make):
    df = many_tasks(make, "task_instance", 20)
    plan = tasks.queued_duration(df, as_of="2024-02-04", analysis_days=20, approximate=0.01)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") == 1 and "Join" not in text


def test_distinct_options(make):
    df = many_tasks(make, "task_instance")
    options = {"as_of": "2024-02-04", "analysis_days": 20}
    exact = tasks.task_retry_patterns(df, **options).collect()
    near = tasks.task_retry_patterns(df, **options, approximate_distinct=0.01).collect()
    assert all(abs(a.unique_runs - b.unique_runs) <= 0.03 * a.unique_runs for a, b in zip(exact, near, strict=True))
    df = many_tasks(make, "dag_run")
    exact, near = (runs.hourly_traffic(df, **options, approximate_distinct=e).collect() for e in (None, 0.01))
    assert [r.avg_unique_dags for r in exact] == pytest.approx([r.avg_unique_dags for r in near], rel=0.03)
