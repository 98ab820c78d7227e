"""All operators over one set of tables."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeexpr import AsOf, in_window
from ..operators import config_audit, documents, failures, forecast, inventory, runs, scheduler, snapshots, tasks
from ..sources.schemas import schema_of
from .settle import settled


@dataclass(frozen=True)
class Settings:
    """What a diagnostics run depends on besides the tables.

    ``cut=True`` keeps only the head of each result (the default limits of the operators), and findings look at the
    ``top_n`` first rows. Counts and totals then stop at those limits; otherwise they are those of all rows.
    """

    as_of: AsOf
    analysis_days: int = 7
    parallelism: int = 32
    max_active_runs: int = 16
    pool_size: int = 5
    max_overflow: int = 10
    large_document_mb: float = 5.0
    critical_document_mb: float = 10.0
    min_success_rate: float = 95.0
    top_n: int = 15
    cut: bool = False
    history_as_of: dict[str, AsOf] = field(default_factory=dict)

    def at(self, table: str) -> AsOf:
        """``as_of`` of a table, for tables whose data ends at another time."""
        return self.history_as_of.get(table, self.as_of)


# results that must read a big table before its window is kept: keeping a row takes all of its columns, some ten times the
# work of one result on the few columns it needs
SHARED_FROM = 8

Step = tuple[tuple[str, ...], Callable[..., DataFrame]]


def steps(s: Settings) -> dict[str, Step]:
    """Result name -> (tables or earlier results it needs, how to compute it)."""
    days = {"analysis_days": s.analysis_days}

    def whole(operator: Callable[..., DataFrame]) -> dict:
        """Arguments that switch an operator's limit off. Pairs of tasks stay a top list: all of them are too many."""
        has_limit = "limit" in inspect.signature(operator).parameters and operator is not failures.error_correlation
        return {"limit": None} if has_limit and not s.cut else {}

    def on(table: str, operator: Callable[..., DataFrame], *others: str, **more) -> Step:
        return (table, *others), lambda *t: operator(*t, as_of=s.at(table), **whole(operator), **more)

    def of(table: str, operator: Callable[..., DataFrame]) -> Step:
        return (table,), lambda t: operator(t, **whole(operator))

    return {
        "run_performance": on("dag_run", runs.run_performance, **days),
        "hourly_traffic": on("dag_run", runs.hourly_traffic, **days),
        "peak_and_quiet_hours": (("hourly_traffic",), runs.peak_and_quiet_hours),
        "dag_frequency": on("dag_run", runs.dag_frequency, **days),
        "schedule_drift": on("dag_run", runs.schedule_drift, **days),
        "scheduling_delay": on("dag_run", runs.scheduling_delay, **days),
        "run_concurrency": on("dag_run", runs.run_concurrency, **days),
        "catchup_backlog": on("dag_run", runs.catchup_backlog),
        "task_concurrency": on("task_instance", runs.task_concurrency, **days),
        "task_duration_trends": on("task_instance", tasks.task_duration_trends, **days),
        "task_retry_patterns": on("task_instance", tasks.task_retry_patterns, **days),
        "queue_depth": on("task_instance", tasks.queue_depth, **days),
        "executor_queue_lag": on("task_instance", tasks.executor_queue_lag, **days),
        "queued_duration": on("task_instance", tasks.queued_duration, **days),
        "pool_utilisation": on("task_instance", tasks.pool_utilisation, "slot_pool", **days),
        "zombie_tasks": on("task_instance", tasks.zombie_tasks),
        "execution_variance": on("task_instance", tasks.execution_variance, **days),
        "sla_miss_patterns": on("sla_miss", tasks.sla_miss_patterns, **days),
        "task_failures": on("task_fail", failures.task_failures, **days),
        "error_clusters": on("task_instance", failures.error_clusters, **days),
        "error_correlation": on("task_fail", failures.error_correlation, **days),
        "transient_vs_persistent": on("task_instance", failures.transient_vs_persistent, **days),
        "error_time_patterns": on("task_fail", failures.error_time_patterns, **days),
        "failure_cascades": on("task_instance", failures.failure_cascades, **days),
        "failure_prediction": on("task_instance", forecast.failure_prediction, **days),
        "capacity_forecast": on("task_instance", forecast.capacity_forecast, **days),
        "performance_degradation": on("task_instance", forecast.performance_degradation, **days),
        "anomaly_detection": on("task_instance", forecast.anomaly_detection, **days),
        "seasonal_patterns": on("task_instance", forecast.seasonal_patterns, **days),
        "heartbeat_gaps": on("job", scheduler.heartbeat_gaps, **days),
        "loop_duration": on("job", scheduler.loop_duration, **days),
        "document_size_status": (
            ("serialized_dag",),
            lambda docs: documents.document_size_summary(
                documents.document_size_status(
                    documents.document_size_profile(docs, as_of=s.at("serialized_dag")),
                    large_mb=s.large_document_mb,
                    critical_mb=s.critical_document_mb,
                )
            ),
        ),
        "serialization_instability": on("serialized_dag", documents.serialization_instability, **days),
        "storage_footprint": of("table_sizes", snapshots.storage_footprint),
        "index_use": of("index_usage", snapshots.index_usage),
        "lock_waits": on("activity", snapshots.lock_waits, "locks"),
        "connection_stats": on("activity", snapshots.connection_stats),
        "config_conflicts": (("settings",), config_audit.config_conflicts),
        "config_change": (("settings",), config_audit.config_change),
        "inventory_summary": (("file_inventory",), inventory.inventory_summary),
    }


def recent_tasks(task_instance: DataFrame, s: Settings) -> DataFrame:
    """The attempts any operator looks at: started, ended or queued in the window, or still running."""
    at, days = s.at("task_instance"), s.analysis_days
    return task_instance.where(
        in_window("start_date", at, days)
        | in_window("end_date", at, days)
        | in_window("queued_dttm", at, days)
        | (F.col("state") == "running")
    ).select(*[f for f in schema_of("task_instance").names if f in task_instance.columns])


def recent_runs(dag_run: DataFrame, s: Settings) -> DataFrame:
    """The runs any operator looks at: scheduled, started or ended in the window, or still queued."""
    at, days = s.at("dag_run"), s.analysis_days
    return dag_run.where(
        in_window("execution_date", at, days)
        | in_window("start_date", at, days)
        | in_window("end_date", at, days)
        | (F.col("state") == "queued")
    ).select(*[f for f in schema_of("dag_run").names if f in dag_run.columns])


def run_diagnostics(
    tables: Mapping[str, DataFrame], settings: Settings, *, settle: bool = False, only: set[str] | None = None
) -> dict[str, DataFrame]:
    """Result name -> DataFrame for every operator whose tables are given.

    Results stay lazy. With ``settle`` each one is computed once and kept in the checkpoint folder, so that findings,
    recommendations and the report all read a few small tables instead of starting from the raw ones again. The window
    of the two big tables is read once and kept (in memory, else on disk) while the results are computed, if at least
    ``SHARED_FROM`` of them read it; what is lost with an executor is read again from the tables.
    ``spark.checkpoint.dir`` must be set for it.
    """
    shared: dict[str, DataFrame] = {}
    if settle:
        wanted = [needs for name, (needs, _) in steps(settings).items() if only is None or name in only]
        for name, recent in (("task_instance", recent_tasks), ("dag_run", recent_runs)):
            if name in tables and sum(name in needs for needs in wanted) >= SHARED_FROM:
                shared[name] = recent(tables[name], settings).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _computed(tables, shared, settings, settled if settle else lambda df: df, only)
    finally:
        for df in shared.values():
            df.unpersist()


def _computed(
    tables: Mapping[str, DataFrame],
    shared: Mapping[str, DataFrame],
    settings: Settings,
    keep: Callable[[DataFrame], DataFrame],
    only: set[str] | None,
) -> dict[str, DataFrame]:
    results: dict[str, DataFrame] = {}
    for name, (needs, compute) in steps(settings).items():
        if only is not None and name not in only:
            continue
        inputs = [results.get(n, shared.get(n, tables.get(n))) for n in needs]
        if any(i is None for i in inputs):
            continue
        results[name] = keep(compute(*inputs))
    counted = {n: tables[n] for n in ("task_instance", "dag_run", "log", "job", "xcom") if n in tables}
    for name, compute in (
        ("table_row_counts", lambda: forecast.table_row_counts(counted)),
        ("table_growth", lambda: _growth(counted, settings)),
    ):
        if counted and (only is None or name in only):
            results[name] = keep(compute())
    return results


def _growth(counted: Mapping[str, DataFrame], s: Settings) -> DataFrame:
    out = None
    for name in forecast.GROWTH_COLUMNS:
        if name in counted:
            part = forecast.table_growth({name: counted[name]}, as_of=s.at(name), analysis_days=s.analysis_days)
            out = part if out is None else out.unionByName(part)
    return out
