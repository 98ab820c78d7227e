"""Inventory of a workflow folder (input: ``file_inventory``: path, size_bytes) and policy checks on definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import labels_that_hold, megabytes
from ..functions.scale import top_rows
from ..functions.text import file_extension


def visible_files(files: DataFrame) -> DataFrame:
    """Leaves out hidden files, files below hidden folders and ``__pycache__``."""
    return files.where(~F.col("path").rlike(r"(^|/)(\.[^/]|__pycache__/)"))


def _is_python() -> Column:
    return F.col("path").endswith(".py")


def inventory_summary(files: DataFrame, *, ignore_file: DataFrame | None = None) -> DataFrame:
    """File counts and sizes, Python and other (one row).

    ``ignore_file`` is the ignore file read as one text row (``value``), if there is one.
    """
    python, size = _is_python(), F.col("size_bytes")
    sums = {
        "total_size_bytes": F.sum(size),
        "python_size_bytes": F.sum(F.when(python, size)),
        "non_python_size_bytes": F.sum(F.when(~python, size)),
    }
    summary = visible_files(files).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(python).alias("python_files_count"),
        F.count_if(~python).alias("non_python_files_count"),
        *[F.coalesce(total, F.lit(0)).alias(name) for name, total in sums.items()],
    )
    for name in sums:
        summary = summary.withColumn(name.replace("_bytes", "_mb"), megabytes(name))
    if ignore_file is None:
        return summary.withColumn("has_ignore_file", F.lit(False)).withColumn("ignore_lines", F.lit(0))
    content = F.btrim(F.col("value"), F.lit(" \t\r\n"))
    lines = ignore_file.agg(
        F.sum(F.when(content == "", 0).otherwise(F.size(F.split(content, "\n")))).alias("lines")
    ).scalar()
    return summary.withColumn("has_ignore_file", lines.isNotNull()).withColumn(
        "ignore_lines", F.coalesce(lines, F.lit(0)).cast("int")
    )


def extension_counts(files: DataFrame) -> DataFrame:
    """Non-Python files per extension, most frequent first."""
    return (
        visible_files(files)
        .where(~_is_python())
        .groupBy(file_extension("path").alias("extension"))
        .agg(F.count(F.lit(1)).alias("files"))
        .orderBy(F.desc("files"), "extension")
    )


def largest_files(files: DataFrame, *, top_n: int = 10) -> DataFrame:
    return top_rows(
        visible_files(files).select("path", "size_bytes", megabytes("size_bytes").alias("size_mb")),
        [F.desc("size_bytes"), F.asc("path")],
        top_n,
    )


def inventory_flags(summary: DataFrame, *, folder_mb: float = 100.0, non_python_mb: float = 10.0) -> DataFrame:
    """Flags raised by ``inventory_summary`` (one row each)."""
    return summary.select(
        F.explode(
            labels_that_hold(
                (~F.col("has_ignore_file"), "NO_IGNORE_FILE"),
                (F.col("non_python_files_count") > 0, "NON_PYTHON_FILES"),
                (F.col("total_size_mb") > folder_mb, "LARGE_FOLDER"),
                (F.col("non_python_size_mb") > non_python_mb, "LARGE_NON_PYTHON"),
            )
        ).alias("flag")
    )


def dag_policy(dag_defs: DataFrame, *, default_tag: str = "default") -> DataFrame:
    """Rejects ``@once`` schedules and tags untagged workflows; columns other than those checked pass through."""
    rejected = F.coalesce(F.col("schedule_interval") == "@once", F.lit(False))
    untagged = F.coalesce(F.size("tags"), F.lit(0)) <= 0
    return (
        dag_defs.withColumn("is_rejected", rejected)
        .withColumn("tags_defaulted", ~rejected & untagged)
        .withColumn(
            "tags", F.when(~rejected & untagged, F.array(F.lit(default_tag))).otherwise(F.col("tags"))
        )
    )


def task_policy(task_defs: DataFrame, *, retries: int = 1) -> DataFrame:
    """Sets every task's retries to ``retries`` and tells where that changed something."""
    kept = F.coalesce(F.col("retries") == retries, F.lit(False))
    return task_defs.withColumn("retries_changed", ~kept).withColumn("retries", F.lit(retries))
