"""Scheduler heartbeats (input: ``job``: hostname, job_type, latest_heartbeat)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import first_label
from ..functions.scale import with_percentiles, sliced_gaps
from ..functions.timeexpr import AsOf, in_window


def _scheduler_gaps(job: DataFrame, as_of: AsOf, analysis_days: int) -> DataFrame:
    beats = job.where(
        (F.col("job_type") == "SchedulerJob") & in_window("latest_heartbeat", as_of, analysis_days, from_midnight=False)
    )
    return sliced_gaps(beats, "hostname", "latest_heartbeat")


def heartbeat_gaps(job: DataFrame, *, as_of: AsOf, analysis_days: int = 7) -> DataFrame:
    """Seconds between consecutive heartbeats per host."""
    gaps = _scheduler_gaps(job, as_of, analysis_days)
    gap = F.col("gap_seconds")
    stats = gaps.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("heartbeat_count"),
        F.avg(gap).alias("avg_gap_seconds"),
        F.max(gap).alias("max_gap_seconds"),
        F.count_if(gap > 60).alias("gaps_over_1min"),
        F.count_if(gap > 300).alias("gaps_over_5min"),
    )
    return with_percentiles(stats, gaps, ["hostname"], "gap_seconds", {"p95_gap_seconds": 0.95}).select(
        "hostname",
        "heartbeat_count",
        "avg_gap_seconds",
        "max_gap_seconds",
        "p95_gap_seconds",
        "gaps_over_1min",
        "gaps_over_5min",
    )


def heartbeat_status(gaps: DataFrame) -> DataFrame:
    """Possible hangs and slow schedulers."""
    return gaps.select(
        "hostname",
        "max_gap_seconds",
        "gaps_over_1min",
        first_label(
            (F.col("max_gap_seconds") > 300, "Possible hang"), (F.col("gaps_over_1min") > 10, "Slow"), otherwise="Normal"
        ).alias("status"),
    )


def loop_duration(job: DataFrame, *, as_of: AsOf, analysis_days: int = 7) -> DataFrame:
    """The same gaps, zero ones left out, read as scheduler loop times."""
    loops = _scheduler_gaps(job, as_of, analysis_days).where(F.col("gap_seconds") > 0)
    gap = F.col("gap_seconds")
    stats = loops.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("loop_count"),
        F.round(F.avg(gap), 2).alias("avg_loop_duration_seconds"),
        F.round(F.max(gap), 2).alias("max_loop_duration"),
        F.count_if(gap > 10).alias("loops_over_10s"),
    )
    return with_percentiles(stats, loops, ["hostname"], "gap_seconds", {"p50": 0.5, "p95": 0.95}).select(
        "hostname",
        "loop_count",
        "avg_loop_duration_seconds",
        F.round("p50", 2).alias("median_loop_duration"),
        F.round("p95", 2).alias("p95_loop_duration"),
        "max_loop_duration",
        "loops_over_10s",
    )
