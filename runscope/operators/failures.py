"""Failures and errors (input: ``task_fail`` or ``task_instance``)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import first_label, percent, ratio
from ..functions.scale import salted_join, top_rows
from ..functions.timeexpr import AsOf, day_of_week, hour_of_day, in_window, seconds_between
from .tasks import TASK, by_task


def task_failures(
    task_fail: DataFrame, *, as_of: AsOf, analysis_days: int = 7, limit: int | None = 50
) -> DataFrame:
    """Failure counts, days and mean duration per task."""
    stats = (
        task_fail.where(in_window("start_date", as_of, analysis_days))
        .groupBy(*TASK)
        .agg(
            F.count(F.lit(1)).alias("failure_count"),
            F.max("start_date").alias("last_failure_date"),
            F.min("start_date").alias("first_failure_date"),
            F.countDistinct(F.to_date("start_date")).alias("failure_days"),
            F.avg(seconds_between("end_date", "start_date")).alias("avg_failure_duration_seconds"),
        )
    )
    return top_rows(stats, by_task(F.desc("failure_count")), limit)


def failures_by_dag(failures: DataFrame, *, top_n: int | None = None) -> DataFrame:
    """Failures per workflow over the ``top_n`` worst tasks of ``task_failures``.

    The totals are those of the workflows only with ``top_n=None`` and uncut ``failures``.
    """
    return (
        top_rows(failures, by_task(F.desc("failure_count")), top_n)
        .groupBy("dag_id")
        .agg(F.sum("failure_count").alias("total_failures"))
        .orderBy(F.desc("total_failures"), "dag_id")
    )


def error_clusters(
    task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7, limit: int | None = 30
) -> DataFrame:
    """Failed attempts per task with a frequency label."""
    n = F.col("occurrence_count")
    stats = (
        task_instance.where(in_window("start_date", as_of, analysis_days) & (F.col("state") == "failed"))
        .groupBy(*TASK)
        .agg(
            F.lit("Failed task").alias("error_snippet"),
            F.count(F.lit(1)).alias("occurrence_count"),
            F.max("start_date").alias("last_occurrence"),
            F.min("start_date").alias("first_occurrence"),
            F.countDistinct(F.to_date("start_date")).alias("days_with_errors"),
        )
        .withColumn(
            "frequency_category",
            first_label((n > 50, "Very High"), (n > 20, "High"), (n > 10, "Medium"), otherwise="Low"),
        )
    )
    return top_rows(stats, by_task(F.desc("occurrence_count")), limit)


def error_correlation(
    task_fail: DataFrame,
    *,
    as_of: AsOf,
    analysis_days: int = 7,
    min_count: int = 3,
    limit: int | None = 20,
    seeds: int = 64,
) -> DataFrame:
    """Pairs of tasks failing in the same hour, counted as failures x failures per hour; exact top ``limit``.

    With n[a, h] failures of task a in hour h, a pair scores the sum over h of n[a, h] * n[b, h]. Not every pair of an
    hour is built. The ``limit``-th best of the pairs scored so far is a threshold that the true top must reach
    (``_threshold``; found at once, in a job or a few that return one row each), and only pairs whose bound reaches it are
    scored (``_meeting``).

    With ``limit=None`` the threshold is ``min_count``, and there can be as many pairs as tasks fail together in an hour.
    """
    per_hour = _failures_per_hour(task_fail, as_of, analysis_days)
    candidates = _meeting(_reach(per_hour), _threshold(per_hour, min_count, limit, seeds))
    # both sides of the scoring joins hold at most one row per (task, hour)
    first = per_hour.select(F.col("task").alias("task1"), "hour", F.col("n").alias("n1"))
    second = per_hour.select(F.col("task").alias("task2"), "hour", F.col("n").alias("n2"))
    scored = (
        candidates.join(first, "task1")
        .join(second, ["task2", "hour"])
        .groupBy("task1", "task2")
        .agg(F.sum(F.col("n1") * F.col("n2")).alias("co_occurrence_count"))
        .where(F.col("co_occurrence_count") >= min_count)
    )
    return top_rows(scored, [F.desc("co_occurrence_count"), F.asc("task1"), F.asc("task2")], limit)


def _failures_per_hour(task_fail: DataFrame, as_of: AsOf, analysis_days: int) -> DataFrame:
    return (
        task_fail.where(in_window("start_date", as_of, analysis_days))
        .groupBy(
            F.date_trunc("hour", "start_date").alias("hour"),
            F.concat_ws(".", "dag_id", "task_id").alias("task"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("hour").isNotNull())
    )


@dataclass(frozen=True)
class Threshold:
    """A pair that counts scores more, or as much and does not come later by its names (no names: any of that score)."""

    score: int
    task1: str | None = None
    task2: str | None = None


def _threshold(per_hour: DataFrame, min_count: int, limit: int | None, seeds: int, stars: int = 4, rounds: int = 3) -> Threshold:
    """The ``limit``-th best of the pairs among the busiest tasks, as many as make ``limit`` pairs and ``seeds`` at least,
    and of the pairs of the few very busiest with any other task. Each further round takes four times as many of both, until
    enough pairs are found."""
    if limit is None or limit < 1:
        return Threshold(min_count)
    own = per_hour.groupBy("task").agg(F.sum(F.col("n") * F.col("n")).alias("own"))
    rows = per_hour.select("hour", "task", "n")

    def busiest(count: int) -> DataFrame:
        return rows.join(own.orderBy(F.desc("own"), "task").limit(count).select("task"), "task").select("hour", "task", "n")

    def scores(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of a few tasks (so few rows of an hour) with others, over all their hours."""
        pairs = left.toDF("hour", "a", "na").join(right.toDF("hour", "b", "nb"), "hour").where(F.col("a") != F.col("b"))
        sums = pairs.groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("score"))
        return sums.select("score", F.least("a", "b").alias("task1"), F.greatest("a", "b").alias("task2"))

    order = [F.desc("score"), F.asc("task1"), F.asc("task2")]
    for no in range(rounds):
        several = busiest(4**no * max(seeds, math.isqrt(2 * limit) + 2))
        scored = scores(several, several).unionByName(scores(busiest(4**no * stars), rows)).distinct()
        best = scored.where(F.col("score") >= min_count).orderBy(*order).limit(limit)
        by_score = best.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("task1", "task2")).alias("names"))
        found, last = by_score.agg(F.sum("n"), F.min(F.struct("score", "names.*"))).first()
        if found == limit:
            return Threshold(*last)
    return Threshold(min_count)


def _reach(per_hour: DataFrame) -> DataFrame:
    """(hour, task, reach, most): what the hours of a task up to this one, from the most to the least crowded, can add to a
    score. ``reach`` is the sum of n * n (so a pair scores at most the root of the product of both), ``most`` the sum of n
    times the greatest n of the hour."""
    crowd = per_hour.groupBy("hour").agg(F.count(F.lit(1)).alias("crowd"), F.max("n").alias("top_n"))
    order = Window.partitionBy("task").orderBy(F.desc("crowd"), "hour").rowsBetween(Window.unboundedPreceding, 0)
    return salted_join(per_hour, crowd, ["hour"], ["task"]).select(
        "hour", "task",
        F.sum(F.col("n") * F.col("n")).over(order).alias("reach"),
        F.sum(F.col("n") * F.col("top_n")).over(order).alias("most"),
    )


def _meeting(rows: DataFrame, threshold: Threshold) -> DataFrame:
    """(task1, task2): all pairs that can reach the threshold, found in the last hour that both share.

    In that hour the product of their reaches is at least the threshold's square. So as not to build all pairs of the hour,
    the different reaches of an hour are paired first, by classes a sixteenth of an octave wide, and tasks meet only where
    theirs do. Pairs that can do no more than tie must come early by name: only tasks up to the threshold's look for them.
    """
    score = F.lit(max(1, threshold.score)).cast("long")
    name1, name2 = F.lit(threshold.task1).cast("string"), F.lit(threshold.task2).cast("string")
    rows = rows.where(F.col("most") >= score).select("hour", "task", "reach")

    def product(a: Column, b: Column) -> Column:
        return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")

    square = product(score, score)
    tied_later = (product(F.col("reach1"), F.col("reach2")) == square) & name1.isNotNull()
    octave = F.log2(F.col("reach").cast("double")) * 16
    values = rows.select("hour", "reach").distinct()
    low = F.greatest(F.lit(0), F.floor(F.log2(score.cast("double")) * 32 - octave) - 1)
    larger = values.where(product(F.col("reach"), F.col("reach")) >= square).select(
        "hour", F.col("reach").alias("reach1"), F.explode(F.sequence(F.least(low, F.floor(octave)), F.floor(octave))).alias("class")
    )
    smaller = values.select("hour", F.col("reach").alias("reach2"), F.floor(octave).alias("class"))
    reaches = larger.join(smaller, ["hour", "class"]).where(
        (F.col("reach1") >= F.col("reach2")) & (product(F.col("reach1"), F.col("reach2")) >= square) & ~tied_later
    )
    left = rows.select("hour", F.col("task").alias("a"), F.col("reach").alias("reach1"))
    right = rows.select("hour", F.col("task").alias("b"), F.col("reach").alias("reach2"))
    meets = salted_join(left, reaches.select("hour", "reach1", "reach2"), ["hour", "reach1"], ["a"])
    above = salted_join(meets, right, ["hour", "reach2"], ["a"]).where(F.col("a") != F.col("b"))

    # conditions on two columns at once stay above the window, so that the table is read once
    early = rows.where(F.when(F.col("reach") > 0, F.col("task") <= name1) & (square % F.col("reach").cast("decimal(19,0)") == 0)).select(
        "hour", F.col("task").alias("a"), (square / F.col("reach").cast("decimal(19,0)")).cast("long").alias("reach2")
    )
    in_time = F.struct("a", "b") <= F.struct(name1.alias("a"), name2.alias("b"))
    ties = salted_join(right, early, ["hour", "reach2"], ["b"]).where((F.col("a") < F.col("b")) & in_time)
    return (
        above.select("a", "b")
        .unionByName(ties.select("a", "b"))
        .select(F.least("a", "b").alias("task1"), F.greatest("a", "b").alias("task2"))
        .distinct()
    )


def transient_vs_persistent(
    task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7, min_count: int = 5, limit: int | None = 30
) -> DataFrame:
    """Whether retried runs end well; attempts after the first only."""
    per_run = (
        task_instance.where(in_window("start_date", as_of, analysis_days) & (F.col("try_number") > 1))
        .groupBy(*TASK, "run_id")
        .agg(F.max(F.when(F.col("state") == "success", 1).otherwise(0)).alias("succeeded"))
    )
    stats = (
        per_run.groupBy(*TASK)
        .agg(F.count(F.lit(1)).alias("retry_runs"), F.sum("succeeded").alias("successful_after_retry"))
        .where(F.col("retry_runs") >= min_count)
    )
    share = ratio("successful_after_retry", "retry_runs")
    return top_rows(stats, by_task(F.desc("retry_runs")), limit).select(
        *TASK,
        "retry_runs",
        "successful_after_retry",
        (F.col("retry_runs") - F.col("successful_after_retry")).alias("persistent_failures"),
        percent("successful_after_retry", "retry_runs").alias("retry_success_rate"),
        first_label((share > 0.8, "Transient"), (share > 0.5, "Mixed"), otherwise="Persistent").alias("failure_type"),
    )


def error_time_patterns(
    task_fail: DataFrame, *, as_of: AsOf, analysis_days: int = 7, limit: int | None = 24
) -> DataFrame:
    """Failures per hour of day, labelled against the mean hour (at most 24 rows reach the window)."""
    cells = (
        task_fail.where(in_window("start_date", as_of, analysis_days))
        .groupBy(hour_of_day("start_date").alias("hour_of_day"), day_of_week("start_date").alias("day_of_week"))
        .agg(F.count(F.lit(1)).alias("errors"))
    )
    hours = cells.groupBy("hour_of_day").agg(
        F.sum("errors").alias("total_errors"),
        F.round(F.avg("errors"), 2).alias("avg_errors_per_day"),
        F.max("errors").alias("max_errors"),
        F.round(F.stddev_samp("errors"), 2).alias("stddev_errors"),
    )
    mean = F.avg("total_errors").over(Window.partitionBy(F.lit(0)))
    total = F.col("total_errors")
    labelled = hours.withColumn(
        "error_intensity", first_label((total > mean * 1.5, "High"), (total > mean, "Medium"), otherwise="Low")
    )
    return top_rows(labelled, [F.desc("total_errors"), F.asc("hour_of_day")], limit)


def failure_cascades(
    task_instance: DataFrame, *, as_of: AsOf, analysis_days: int = 7, min_tasks: int = 3, limit: int | None = 20
) -> DataFrame:
    """Workflows with runs in which several different tasks failed."""
    per_run = (
        task_instance.where(in_window("start_date", as_of, analysis_days) & (F.col("state") == "failed"))
        .groupBy("dag_id", "run_id")
        .agg(F.countDistinct("task_id").alias("failed_tasks"))
        .where(F.col("failed_tasks") >= min_tasks)
    )
    stats = per_run.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("cascade_count"),
        F.round(F.avg("failed_tasks"), 2).alias("avg_tasks_per_cascade"),
        F.max("failed_tasks").alias("max_tasks_in_cascade"),
        F.lit(0).alias("avg_cascade_duration_seconds"),
    )
    return top_rows(stats, [F.desc("cascade_count"), F.asc("dag_id")], limit)
