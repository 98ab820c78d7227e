"""Ordered actions derived from findings and a few headline numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import Settings
from .findings import CRITICAL, WARNING


def headline_numbers(results: Mapping[str, DataFrame], found: DataFrame) -> DataFrame:
    """(metric, value): finding counts per domain and severity, and key numbers of the results at hand."""
    parts = [
        found.groupBy(F.concat_ws(".", F.lit("findings"), "domain", "severity").alias("metric")).agg(
            F.count(F.lit(1)).cast("double").alias("value")
        )
    ]

    def number(name: str, result: str, value: Column) -> None:
        if result in results:
            parts.append(results[result].agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value"))

    rows = F.count(F.lit(1))
    severity = F.col("severity")
    number("cascading_dags", "failure_cascades", rows)
    number("config_critical", "config_conflicts", F.count_if(severity == "CRITICAL"))
    number("config_warning", "config_conflicts", F.count_if(severity == "WARNING"))
    number("config_changes", "config_change", F.count_if(F.col("config_changed")))
    number("documents", "document_size_status", F.max("total_dags"))
    number("suspicious_documents", "document_size_status", F.max("suspicious_dags"))
    number("max_document_mb", "document_size_status", F.max("max_size_mb"))
    number("avg_success_rate", "run_performance", F.avg("success_rate_percent"))
    number("active_dags", "run_performance", rows)
    number("failing_tasks", "task_failures", rows)
    number("unstable_documents", "serialization_instability", rows)
    number("increasing_tasks", "failure_prediction", F.count_if(F.col("failure_trend") == "Increasing"))
    number("queued_runs", "catchup_backlog", F.coalesce(F.sum("queued_runs"), F.lit(0)))
    number("zombie_tasks", "zombie_tasks", rows)
    number("max_queued", "queue_depth", F.max("max_queued"))
    number("task_rows", "table_row_counts", F.max(F.when(F.col("table_name") == "task_instance", F.col("row_count"))))
    number("peak_runs", "run_concurrency", F.max("max_concurrent_dags"))
    number("peak_tasks", "task_concurrency", F.max("max_concurrent_tasks"))
    number("without_ignore_file", "inventory_summary", F.count_if(~F.col("has_ignore_file")))
    number("non_python_files", "inventory_summary", F.max("non_python_files_count"))
    number("folder_mb", "inventory_summary", F.max("total_size_mb"))
    number("non_python_mb", "inventory_summary", F.max("non_python_size_mb"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rules(s: Settings) -> list[tuple[str, str, float, str]]:
    """(metric, comparison, limit, message) in the order of the report."""

    def of(domain: str, severity: str) -> str:
        return f"findings.{domain}.{severity}"

    return [
        (of("errors", CRITICAL), ">", 0, "Urgent: fix %.0f critical error patterns"),
        ("cascading_dags", ">", 0, "Improve error handling of %.0f workflows with failure cascades"),
        (of("scheduler", CRITICAL), ">", 0, "Urgent: resolve %.0f critical scheduler issues"),
        ("config_critical", ">", 0, "Urgent: resolve %.0f critical configuration conflicts"),
        ("config_warning", ">", 0, "Review %.0f configuration warnings"),
        ("config_changes", ">", 0, "Check the effect of %.0f recent configuration changes"),
        ("max_document_mb", ">", s.critical_document_mb, "Make large workflows smaller, the largest takes %.1f MB"),
        ("avg_success_rate", "<", s.min_success_rate, "Investigate failing runs, the success rate is %.1f percent"),
        ("failing_tasks", ">", 10, "Review %.0f failing tasks"),
        ("unstable_documents", ">", 0, "Investigate %.0f workflows whose document keeps changing"),
        (of("predictive", CRITICAL), ">", 0, "Urgent: act on %.0f critical forecasts"),
        (of("predictive", WARNING), ">", 0, "Review %.0f forecast warnings"),
        ("increasing_tasks", ">", 5, "Investigate %.0f tasks that fail more and more"),
        (of("timing", CRITICAL), ">", 0, "Urgent: address %.0f critical timing issues"),
        (of("timing", WARNING), ">", 0, "Review %.0f timing warnings"),
        ("queued_runs", ">", 50, "Clear the backlog of %.0f queued runs"),
        (of("execution", CRITICAL), ">", 0, "Urgent: address %.0f critical task execution issues"),
        (of("execution", WARNING), ">", 0, "Review %.0f task execution warnings"),
        ("zombie_tasks", ">", 0, "Clear %.0f tasks stuck in the running state"),
        ("max_queued", ">", 100, "Raise parallelism or worker capacity, up to %.0f tasks were queued"),
        (of("database", CRITICAL), ">", 0, "Urgent: address %.0f critical database issues"),
        (of("database", WARNING), ">", 0, "Review %.0f database warnings"),
        ("task_rows", ">", 5_000_000, "Clean up task_instance, it holds %.0f rows"),
        (of("traffic", CRITICAL), ">", 0, "Address %.0f critical traffic issues"),
        (of("traffic", WARNING), ">", 0, "Review %.0f traffic warnings"),
        ("peak_runs", ">", 50, "Check scheduler capacity, up to %.0f runs were open at once"),
        ("peak_tasks", ">", 100, "Check parallelism, up to %.0f tasks were open at once"),
        ("without_ignore_file", ">", 0, "Add an ignore file to keep other files from being parsed"),
        ("non_python_files", ">", 0, "Review %.0f non-Python files in the workflow folder"),
        ("folder_mb", ">", 100, "Clean up the workflow folder of %.2f MB"),
        ("non_python_mb", ">", 10, "Move data files of %.2f MB out of the workflow folder"),
    ]


def recommendations(numbers: DataFrame, settings: Settings) -> DataFrame:
    """(position, rule_no, recommendation) for the rules that hold, or one line saying all is well.

    ``numbers`` has a fixed set of metrics, so one aggregate row carries all of them.
    """
    rules = _rules(settings)
    metrics = sorted({metric for metric, *_ in rules})
    row = numbers.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m.replace(".", "__")) for m in metrics])
    lines = []
    for no, (metric, comparison, limit, message) in enumerate(rules, start=1):
        value = F.col(metric.replace(".", "__"))
        holds = value > limit if comparison == ">" else value < limit
        text = F.format_string(message, value) if "%" in message else F.lit(message)
        lines.append(F.when(holds, F.struct(F.lit(no).alias("rule_no"), text.alias("recommendation"))))
    fired = F.array_compact(F.array(*lines))
    well = F.array(F.struct(F.lit(0).alias("rule_no"), F.lit("All checks passed, keep monitoring").alias("recommendation")))
    listed = row.select(F.inline(F.when(F.size(fired) > 0, fired).otherwise(well)))
    return listed.select(F.row_number().over(Window.orderBy("rule_no")).alias("position"), "rule_no", "recommendation")
