"""The skew-safe building blocks against brute force, and the shape of the plans they give."""

from __future__ import annotations

import heapq
import itertools
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.bindings import ORDERS_AS_OF, RBAC, table
from runscope.functions import scale
from runscope.functions.timeexpr import timestamp_lit
from runscope.operators import failures, identity, rbac, runs, scheduler, tasks

T0 = datetime(2024, 1, 1)


def skewed_values(n: int, seed: int = 7) -> list[tuple[str, float]]:
    rng = random.Random(seed)
    hot = [("hot", rng.choice([0.0, 1.0, 1.0, rng.uniform(-5, 5), rng.lognormvariate(3, 2)])) for _ in range(n)]
    return hot + [(f"k{rng.randrange(20)}", float(rng.randrange(50))) for _ in range(n // 2)] + [("one", 4.5)]


def test_percentiles_match_numpy(spark):
    rows = skewed_values(3000)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in scale.exact_percentiles(df, ["k"], "v", wanted).collect()}
    by_key = defaultdict(list)
    for k, v in rows:
        by_key[k].append(v)
    assert set(got) == set(by_key)
    for k, values in by_key.items():
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-9), (k, name)


def test_percentiles_with_weights_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 10, 1), ("a", None, 9), ("b", 2, 2)], "k string, v int, n int")
    got = {r["k"]: r["p"] for r in scale.exact_percentiles(df, ["k"], "v", {"p": 0.95}, weight="n").collect()}
    assert got == pytest.approx({"a": np.percentile([1, 1, 1, 10], 95), "b": 2.0})


def brute_load(spans, start, end):
    points = {t for s, e, _ in spans for t in (s, e) if t is not None and start <= t < end}
    counted = [(s, e) for s, e, c in spans if c and s is not None and start <= s < end]
    return {p: sum(1 for s, e in counted if s <= p and (e is None or e >= p)) for p in points}


def test_interval_load_matches_stabbing_join(spark):
    rng = random.Random(3)
    start, end = T0 + timedelta(days=1), T0 + timedelta(days=3)
    spans = []
    for _ in range(800):
        s = T0 + timedelta(seconds=rng.randrange(0, 4 * 86400, 450))
        e = rng.choice([None, s, s - timedelta(seconds=900), s + timedelta(seconds=rng.randrange(0, 90000, 450))])
        spans.append((s if rng.random() > 0.05 else None, e, rng.random() > 0.3))
    df = spark.createDataFrame(spans, "start timestamp, end timestamp, counted boolean")
    got = scale.interval_load(df, timestamp_lit(start), timestamp_lit(end), 3).collect()
    assert {r["t"]: r["load"] for r in got} == brute_load(spans, start, end)


def test_touching_intervals_count_together(spark, make):
    runs_ = make(
        "dag_run",
        [
            {"dag_id": "a", "start_date": "2024-01-01 00:00:00", "end_date": "2024-01-01 01:00:00"},
            {"dag_id": "b", "start_date": "2024-01-01 01:00:00", "end_date": "2024-01-01 02:00:00"},
        ],
    )
    row = runs.run_concurrency(runs_, as_of="2024-01-02").first()
    assert (row["max_concurrent_dags"], round(row["avg_concurrent_dags"], 4)) == (2, 1.3333)


def test_concurrency_of_nothing(make):
    row = runs.task_concurrency(make("task_instance", []), as_of="2024-01-02").first()
    assert (row["max_concurrent_tasks"], row["p95_concurrent_tasks"], row["sample_points"]) == (None, None, 0)


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**7])
def test_gaps_match_lag(spark, slice_seconds):
    rng = random.Random(5)
    rows = [("hot", T0 + timedelta(seconds=rng.randrange(400_000))) for _ in range(1500)]
    rows += [(f"h{i % 5}", T0 + timedelta(seconds=rng.randrange(400_000))) for i in range(200)] + [("single", T0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp").repartition(5)
    got = Counter((r["k"], r["gap_seconds"]) for r in scale.sliced_gaps(df, "k", "ts", slice_seconds).collect())
    want = Counter()
    by_key = defaultdict(list)
    for k, t in rows:
        by_key[k].append(t)
    for k, times in by_key.items():
        times.sort()
        want.update((k, (b - a).total_seconds()) for a, b in zip(times, times[1:]))
    assert got == want


def test_previous_value_crosses_slices(spark):
    rows = [("a", T0 + timedelta(hours=h), f"v{h}") for h in (0, 1, 30, 200, 201)] + [("b", T0, "x")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v string")
    got = {(r["k"], r["v"]): r["before"] for r in scale.with_previous(df, "k", "ts", "v", "before").collect()}
    assert got == {("a", "v0"): None, ("a", "v1"): "v0", ("a", "v30"): "v1", ("a", "v200"): "v30", ("a", "v201"): "v200", ("b", "x"): None}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    big = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(300)], "k int, i int")
    small = spark.createDataFrame([(0, "zero"), (2, "two"), (2, "again")], "k int, name string")
    plain = Counter(tuple(r) for r in big.join(small, "k", how).collect())
    assert Counter(tuple(r) for r in scale.salted_join(big, small, ["k"], ["i"], how).collect()) == plain


def test_salted_join_counts_the_repeated_rows_before_a_broadcast(spark):
    """200,000 rows are below the threshold of 10 MB, their 16 copies are not."""
    big, small = spark.range(10_000_000).selectExpr("id AS k", "id AS i"), spark.range(200_000).selectExpr("id AS k")
    plan = scale.salted_join(big, small, ["k"], ["i"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_row_numbers_are_dense(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("name"))
    numbers = [r["no"] for r in scale.with_row_numbers(df, ["name"], "no").collect()]
    assert sorted(numbers) == list(range(1, 5001))


def correlated(rows, min_count=3):
    per_hour = Counter((t.replace(minute=0, second=0), f"{d}.{k}") for d, k, t in rows)
    by_hour = defaultdict(dict)
    for (hour, name), n in per_hour.items():
        by_hour[hour][name] = n
    scores = Counter()
    for names in by_hour.values():
        for a in names:
            for b in names:
                if a < b:
                    scores[(a, b)] += names[a] * names[b]
    return sorted(((-n, a, b) for (a, b), n in scores.items() if n >= min_count))


@pytest.mark.parametrize("seed", range(3))
def test_error_correlation_is_exact(spark, seed):
    rng = random.Random(seed)
    rows = []
    for hour in range(40):
        crowd = 30 if hour % 10 == 0 else 4  # a few hours in which nearly everything fails
        for _ in range(crowd):
            task = min(int(rng.paretovariate(0.8)), 40)
            rows += [("d", f"t{task:02d}", T0 + timedelta(hours=hour, minutes=rng.randrange(60)))] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "dag_id string, task_id string, start_date timestamp")
    want = correlated(rows)
    for limit, seeds in ((5, 4), (20, 64), (None, 64)):
        got = failures.error_correlation(df, as_of="2024-01-05", limit=limit, seeds=seeds).collect()
        assert [(-r["co_occurrence_count"], r["task1"], r["task2"]) for r in got] == want[:limit], (limit, seeds)


def test_pairs_beyond_the_registered_bound(spark):
    from checks.catalogue import REGISTER

    assert "c04_error_correlation_top2000" in REGISTER and "c04_error_correlation_all" not in REGISTER
    rows = [("d", f"t{i:02d}", T0 + timedelta(minutes=m)) for i in range(65) for m in (1, 2)]
    df = spark.createDataFrame(rows, "dag_id string, task_id string, start_date timestamp")
    got = failures.error_correlation(df, as_of="2024-01-05", limit=None).collect()
    assert len(got) == 65 * 64 // 2 > 2000
    assert [(-r["co_occurrence_count"], r["task1"], r["task2"]) for r in got] == correlated(rows)


CROWDS = {
    "all alike": lambda rng, i: 3,
    "a few counts": lambda rng, i: rng.randrange(1, 6),
    "a long tail": lambda rng, i: min(int(rng.paretovariate(0.9)), 400),
    "one above all": lambda rng, i: 50 if i == 700 else 2,
}


@pytest.mark.parametrize("crowd", CROWDS)
def test_a_crowded_hour_gives_few_candidates(spark, crowd):
    """Thousands of tasks failing in one hour: the pairs scored stay near the limit, and the top is exact."""
    rng, limit = random.Random(5), 2000
    counts = [(f"d.t{i:04d}", CROWDS[crowd](rng, i)) for i in range(3000)]
    rng.shuffle(counts)
    per_hour = spark.createDataFrame([(T0, t, n) for t, n in counts], "hour timestamp, task string, n bigint")
    threshold = failures._threshold(per_hour, 3, limit, 64)
    candidates = failures._meeting(failures._reach(per_hour), threshold).collect()
    assert limit <= len(candidates) <= 3 * limit
    n = dict(counts)
    least = heapq.nsmallest(limit, ((-n[a] * n[b], a, b) for a, b in itertools.combinations(sorted(n), 2)))
    found = sorted((-n[r.task1] * n[r.task2], r.task1, r.task2) for r in candidates)
    assert found[:limit] == least


def test_crowded_hours_of_many_tasks(spark):
    """Several hours, so that bounds are not the scores: still exact, and far from all pairs."""
    rng, limit = random.Random(6), 500
    rows = []
    for hour in range(6):
        for i in range(600):
            n = min(int(rng.paretovariate(1.0)), 60)
            if rng.random() < 0.7:
                rows += [("d", f"t{i:03d}", T0 + timedelta(hours=hour, minutes=rng.randrange(60)))] * n
    df = spark.createDataFrame(rows, "dag_id string, task_id string, start_date timestamp")
    got = failures.error_correlation(df, as_of="2024-01-05", limit=limit).collect()
    assert [(-r["co_occurrence_count"], r["task1"], r["task2"]) for r in got] == correlated(rows)[:limit]
    per_hour = failures._failures_per_hour(df, "2024-01-05", 7)
    threshold = failures._threshold(per_hour, 3, limit, 64)
    assert failures._meeting(failures._reach(per_hour), threshold).count() < 20 * limit < 600 * 599 // 2


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("operator", "source", "scans"),
    [
        (runs.schedule_drift, "dag_run", 2),
        (runs.run_concurrency, "dag_run", 1),
        (runs.run_performance, "dag_run", 1),
        (tasks.task_duration_trends, "task_instance", 2),
        (tasks.executor_queue_lag, "task_instance", 2),
        (tasks.queue_depth, "task_instance", 1),
    ],
)
def test_scans_and_joins(spark, operator, source, scans):
    text = plan(operator(table(spark, SF, source), as_of=ORDERS_AS_OF, analysis_days=365))
    assert len(re.findall(r"FileScan parquet", text)) == scans
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_correlation_and_heartbeats_share_their_shuffles(spark):
    for limit in (None, 5, 2000):
        df = failures.error_correlation(table(spark, SF, "task_fail"), as_of="2024-01-31", analysis_days=30, limit=limit)
        text = plan(df)
        assert len(re.findall(r"FileScan parquet", text)) <= 1, (limit, text)
    assert "CartesianProduct" not in text
    text = plan(scheduler.heartbeat_gaps(table(spark, SF, "job"), as_of="2024-01-31", analysis_days=30))
    assert len(re.findall(r"FileScan parquet", text)) == 2


def test_window_reaches_the_scan(spark, tmp_path, make):
    path = str(tmp_path / "dag_run")
    make("dag_run", [{"dag_id": "a", "execution_date": "2024-01-01 00:00:00", "state": "success"}]).write.parquet(path)
    text = plan(runs.run_performance(spark.read.parquet(path), as_of="2024-01-02"))
    assert "GreaterThanOrEqual(execution_date" in text
    assert "run_id" not in re.search(r"ReadSchema: (\S+)", text).group(1)


NULL_KEY = [
    {"dag_id": d, "task_id": "t", "run_id": f"r{i}", "state": "success", "try_number": 1, "queued_dttm": q, "execution_date": e,
     "start_date": s, "end_date": f"{s[:10]} 05:00:00"}
    for d in ("a", None)
    for i, (e, q, s) in enumerate([
        ("2024-01-10 00:00:00", "2024-01-10 00:10:00", "2024-01-10 00:20:00"),
        ("2024-01-11 00:00:00", "2024-01-11 00:30:00", "2024-01-11 01:00:00"),
        ("2024-01-28 00:00:00", "2024-01-28 00:10:00", "2024-01-28 00:30:00"),
    ])
]


@pytest.mark.parametrize("name", ["schedule_drift", "scheduling_delay", "task_duration_trends", "executor_queue_lag", "queued_duration"])
def test_same_rows_with_and_without_a_limit(make, name):
    operator = getattr(runs, name, None) or getattr(tasks, name)
    rows = make("dag_run" if hasattr(runs, name) else "task_instance", NULL_KEY)
    more = {"min_count": 1} if name in ("task_duration_trends", "executor_queue_lag") else {}
    days = {"analysis_days": 30}
    uncut = operator(rows, as_of="2024-01-30", limit=None, **days, **more).collect()
    assert [r["dag_id"] for r in uncut] == [None, "a"]
    assert all(r[c] is not None for r in uncut for c in r.asDict() if c.startswith("p95"))
    for limit in (1, 2, 5):
        assert operator(rows, as_of="2024-01-30", limit=limit, **days, **more).collect() == uncut[:limit]


def test_a_group_of_nulls_keeps_its_row(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 4.0)], "k string, v double")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    uncut = scale.top_with_percentiles(stats, df, ["k"], "v", {"p": 0.5}, [F.asc("k")], None).collect()
    assert [tuple(r) for r in uncut] == [(None, 1, 4.0), ("a", 2, None), ("b", 1, 2.0)]
    assert scale.top_with_percentiles(stats, df, ["k"], "v", {"p": 0.5}, [F.asc("k")], 2).collect() == uncut[:2]


def test_roles_and_patches_read_their_tables_few_times(spark):
    tables = {n: table(spark, SF, n) for n in RBAC}
    new = rbac.derive_role(tables, "User", "Restricted", ["dag_1"])
    text = plan(new.permissions)
    assert len(re.findall(r"Scan ", text)) <= 9
    users = tables["ab_user"]
    columns = ["username", "email", "first_name", "last_name"]
    patches = users.selectExpr(
        "id AS request_id", "username", *[f"CAST(NULL AS string) AS new_{c}" for c in columns], "CAST(NULL AS boolean) AS new_active",
        "CAST(NULL AS array<string>) AS new_roles", "CAST(NULL AS string) AS update_mask",
    )
    text = plan(identity.patch_users(users, tables["ab_role"], patches).users)
    assert len(re.findall(r"Scan ", text)) <= 9
