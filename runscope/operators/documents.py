"""Serialized workflow documents (input: ``serialized_dag``).

Measures are taken from the whole text in one projection; later steps carry numbers, not texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import first_label, kilobytes, labels_that_hold, megabytes
from ..functions.scale import top_rows
from ..functions.text import (
    first_contained,
    json_depth,
    json_is_valid,
    occurrences,
)
from ..functions.timeexpr import AsOf, in_window, seconds_between, timestamp_lit
from .runs import counts_per_bucket

# fixed values: text markers and labels, tested in this order
OPERATOR_TYPES = [
    ("BashOperator", "BashOperator"),
    ("PythonOperator", "PythonOperator"),
    ("S3", "S3Operations"),
    ("Glue", "GlueOperator"),
    ("Kubernetes", "KubernetesOperator"),
    ("Docker", "DockerOperator"),
]
COMPLEXITY = [
    ("depends_on_past", "Has Dependencies"),
    ("retries", "Has Retries"),
    ("pool", "Uses Pools"),
    ("sla", "Has SLA"),
]

# fixed values: size bucket labels
MB_BUCKETS = ["<50KB", "50-500KB", "500KB-1MB", "1-5MB", ">5MB"]
KB_BUCKETS = ["<50KB", "50-100KB", "100-500KB", "500KB-1MB", ">1MB"]


def document_size_profile(
    serialized_dag: DataFrame,
    *,
    as_of: AsOf,
    operator_types: Sequence[tuple[str, str]] = OPERATOR_TYPES,
    complexity: Sequence[tuple[str, str]] = COMPLEXITY,
    top_n: int | None = None,
) -> DataFrame:
    """Sizes, age, estimated tasks and content labels of each document; largest first when ``top_n`` is given.

    ``storage_size_*`` is the compressed form where there is one, else the text.
    """
    size = F.octet_length("data")
    compressed = F.coalesce(F.octet_length("data_compressed") > 0, F.lit(False))
    stored = F.when(compressed, F.octet_length("data_compressed")).otherwise(size)
    profile = serialized_dag.where(F.col("data").isNotNull()).select(
        "dag_id",
        "fileloc",
        F.when(compressed, "Compressed").otherwise("Uncompressed").alias("compression_status"),
        size.alias("serialized_size_bytes"),
        kilobytes(size).alias("serialized_size_kb"),
        megabytes(size).alias("serialized_size_mb"),
        stored.alias("storage_size_bytes"),
        kilobytes(stored).alias("storage_size_kb"),
        megabytes(stored).alias("storage_size_mb"),
        "last_updated",
        F.floor(seconds_between(timestamp_lit(as_of), "last_updated") / F.lit(86_400.0)).alias("days_since_update"),
        "dag_hash",
        "processor_subdir",
        occurrences("data", '"task_id"').alias("estimated_task_count"),
        first_contained("data", list(operator_types), "Other").alias("primary_operator_type"),
        first_contained("data", list(complexity), "Standard").alias("complexity_indicators"),
        F.length("data").alias("total_length"),
    )
    if top_n is None:
        return profile
    return top_rows(profile, [F.desc("total_length"), F.asc("dag_id"), F.asc("fileloc")], top_n)


def size_bucket_mb(mb: Column) -> Column:
    return first_label(
        (mb < 0.05, MB_BUCKETS[0]), (mb < 0.5, MB_BUCKETS[1]), (mb < 1, MB_BUCKETS[2]), (mb < 5, MB_BUCKETS[3]),
        otherwise=MB_BUCKETS[4],
    )


def size_bucket_kb(kb: Column) -> Column:
    return first_label(
        (kb < 50, KB_BUCKETS[0]), (kb < 100, KB_BUCKETS[1]), (kb < 500, KB_BUCKETS[2]), (kb < 1024, KB_BUCKETS[3]),
        otherwise=KB_BUCKETS[4],
    )


def document_size_status(
    profile: DataFrame,
    *,
    large_mb: float = 5.0,
    critical_mb: float = 10.0,
    serialization_mb: float = 10.0,
    very_large_mb: float = 20.0,
    extreme_mb: float = 50.0,
    few_tasks: int = 10,
    unit_bytes: int = 1_048_576,
) -> DataFrame:
    """Size bucket, issues and the most severe status per document.

    ``unit_bytes`` is the size all limits are multiples of (pass 1024 to read them as KB).
    """
    size = F.round(F.col("serialized_size_bytes") / F.lit(float(unit_bytes)), 2)
    critical, extreme = size > critical_mb, size > extreme_mb
    few = (size > large_mb) & (F.col("estimated_task_count") < few_tasks)
    issues = labels_that_hold(
        (critical, "CRITICAL_SIZE"),
        (~critical & (size > large_mb), "LARGE_SIZE"),
        (extreme, "EXTREMELY_LARGE"),
        (~extreme & (size > very_large_mb), "VERY_LARGE"),
        (~extreme & (size <= very_large_mb) & (size > serialization_mb), "LARGE_SERIALIZATION"),
        (few, "LARGE_WITH_FEW_TASKS"),
    )
    return profile.select(
        "dag_id",
        "fileloc",
        "serialized_size_bytes",
        "serialized_size_mb",
        "estimated_task_count",
        size_bucket_mb(F.col("serialized_size_mb")).alias("size_bucket"),
        issues.alias("issues"),
    ).withColumn(
        "status",
        first_label((critical | extreme, "Critical"), (F.size("issues") > 0, "Warning"), otherwise="Normal"),
    )


def document_size_summary(status: DataFrame) -> DataFrame:
    """Totals over ``document_size_status`` (one row)."""
    return status.agg(
        F.count(F.lit(1)).alias("total_dags"),
        F.round(F.avg("serialized_size_bytes") / F.lit(1048576.0), 4).alias("avg_size_mb"),
        F.round(F.max("serialized_size_bytes") / F.lit(1048576.0), 4).alias("max_size_mb"),
        F.round(F.min("serialized_size_bytes") / F.lit(1024.0), 2).alias("min_size_kb"),
        F.count_if(F.size("issues") > 0).alias("suspicious_dags"),
    )


def compression_summary(profile: DataFrame) -> DataFrame:
    """Count, mean and largest size of compressed and uncompressed documents."""
    return profile.groupBy("compression_status").agg(
        F.count(F.lit(1)).alias("dags"),
        F.round(F.avg("serialized_size_kb"), 2).alias("avg_size_kb"),
        F.max("serialized_size_kb").alias("max_size_kb"),
    )


def largest_documents(profile: DataFrame, *, top_n: int = 10) -> DataFrame:
    return top_rows(
        profile.select(
            "dag_id",
            "fileloc",
            "serialized_size_bytes",
            "serialized_size_mb",
            "storage_size_mb",
            "compression_status",
            "estimated_task_count",
            "primary_operator_type",
        ),
        [F.desc("serialized_size_bytes"), F.asc("dag_id"), F.asc("fileloc")],
        top_n,
    )


def size_histogram(profile: DataFrame, *, variant: str = "mb") -> DataFrame:
    """Documents per size bucket, empty buckets included; ``variant`` picks the mb or the kb edges."""
    if variant == "mb":
        bucket, labels = size_bucket_mb(F.col("serialized_size_mb")), MB_BUCKETS
    elif variant == "kb":
        bucket, labels = size_bucket_kb(F.col("serialized_size_kb")), KB_BUCKETS
    else:
        raise ValueError(f"variant must be 'mb' or 'kb', not {variant!r}")
    return counts_per_bucket(profile.select(bucket.alias("bucket")), labels, "dags")


def serialization_instability(
    serialized_dag: DataFrame, *, as_of: AsOf, analysis_days: int = 7, min_hashes: int = 3
) -> DataFrame:
    """Workflows whose document took more than ``min_hashes`` different contents in the window."""
    size = F.octet_length("data")
    return (
        serialized_dag.where(in_window("last_updated", as_of, analysis_days, from_midnight=False))
        .groupBy("dag_id")
        .agg(
            F.count(F.lit(1)).alias("update_frequency"),
            F.min("last_updated").alias("first_seen"),
            F.max("last_updated").alias("last_seen"),
            F.countDistinct("dag_hash").alias("hash_variations"),
            F.avg(size).alias("avg_size_bytes"),
            F.max(size).alias("max_size_bytes"),
            F.min(size).alias("min_size_bytes"),
        )
        .where(F.col("hash_variations") > min_hashes)
        .orderBy(F.desc("hash_variations"), F.desc("update_frequency"), "dag_id")
    )


def frequent_updates(
    serialized_dag: DataFrame, *, as_of: AsOf, analysis_days: int = 7, versions: int = 100, min_hashes: int = 5
) -> DataFrame:
    """Workflows with more than ``min_hashes`` contents among their latest ``versions`` documents.

    The row-number limit is applied before the shuffle too, so a task sends at most ``versions`` rows per workflow.
    """
    latest = Window.partitionBy("dag_id").orderBy(F.desc("last_updated"), F.desc("dag_hash"))
    recent = (
        serialized_dag.where(in_window("last_updated", as_of, analysis_days, from_midnight=False))
        .select("dag_id", "last_updated", "dag_hash", F.row_number().over(latest).alias("rn"))
        .where(F.col("rn") <= versions)
    )
    return (
        recent.groupBy("dag_id")
        .agg(
            F.count(F.lit(1)).alias("update_frequency"),
            F.min("last_updated").alias("first_seen"),
            F.max("last_updated").alias("last_seen"),
            F.countDistinct("dag_hash").alias("hash_variations"),
        )
        .where(F.col("hash_variations") > min_hashes)
        .orderBy(F.desc("update_frequency"), F.desc("hash_variations"), "dag_id")
    )


def structure_counts(
    serialized_dag: DataFrame, *, large_mb: float = 5.0, max_open_braces: int = 10_000
) -> DataFrame:
    """Bracket counts, size and structural issues per document."""
    size = F.length("data")
    counts = serialized_dag.where(F.col("data").isNotNull()).select(
        "dag_id",
        "fileloc",
        size.alias("size_bytes"),
        kilobytes(size).alias("size_kb"),
        megabytes(size).alias("size_mb"),
        "last_updated",
        "dag_hash",
        occurrences("data", "{").alias("open_braces"),
        occurrences("data", "}").alias("close_braces"),
        occurrences("data", "[").alias("open_brackets"),
        occurrences("data", "]").alias("close_brackets"),
    )
    return counts.withColumn(
        "issues",
        labels_that_hold(
            (F.col("size_mb") > large_mb, "LARGE_SIZE"),
            (F.col("open_braces") != F.col("close_braces"), "UNBALANCED_BRACES"),
            (F.col("open_brackets") != F.col("close_brackets"), "UNBALANCED_BRACKETS"),
            (F.col("open_braces") > max_open_braces, "DEEP_NESTING"),
        ),
    )


def document_risk(counts: DataFrame, *, unit_bytes: int = 1_048_576) -> DataFrame:
    """Risk level by size (limits 5, 1 and 0.5 units) for the rows of ``structure_counts``."""
    size = F.round(F.col("size_bytes") / F.lit(float(unit_bytes)), 2)
    return counts.select(
        "dag_id",
        "fileloc",
        "size_bytes",
        "open_braces",
        first_label((size > 5, "CRITICAL"), (size > 1, "HIGH"), (size > 0.5, "MEDIUM"), otherwise="LOW").alias("risk"),
    )


def issue_breakdown(with_issues: DataFrame) -> DataFrame:
    """Documents per issue, for any rows with an ``issues`` array.

    Rows without issues go after the array is built: a plain explode has them filtered before, by a copy of all that
    the array is made of.
    """
    return (
        with_issues.select(F.explode_outer("issues").alias("issue"))
        .where(F.col("issue").isNotNull())
        .groupBy("issue")
        .agg(F.count(F.lit(1)).alias("dags"))
        .orderBy("issue")
    )


def suspicious_summary(counts: DataFrame) -> DataFrame:
    """How many documents have issues and how large those are (one row)."""
    suspicious = F.size("issues") > 0
    size = F.when(suspicious, F.col("size_mb"))
    return counts.agg(
        F.count(F.lit(1)).alias("total_analyzed"),
        F.count_if(suspicious).alias("total_suspicious"),
        F.round(F.avg(size), 4).alias("avg_suspicious_mb"),
        F.max(size).alias("max_suspicious_mb"),
    )


def json_validity(documents: DataFrame, *, text: str = "data") -> DataFrame:
    """Adds ``json_valid``."""
    return documents.withColumn("json_valid", json_is_valid(text))


def content_checks(
    documents: DataFrame,
    *,
    text: str = "data",
    max_references: int = 10,
    max_tasks: int = 1000,
    max_depth: int = 20,
    large_string_chars: int = 10_240,
    max_repeats: int = 5,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Content checks of valid JSON documents: measures plus the issues they raise (null where JSON is invalid).

    ``only`` names the measures to take; issues of the others are not looked for.
    """
    t = F.col(text)
    valid = F.col("json_valid")
    measures = {
        "json_depth": json_depth(F.when(valid, t)),
        "dag_references": occurrences(t, '"_dag"'),
        "task_references": occurrences(t, '"task_id"'),
        "has_pickle": t.contains('"pickle"') | t.contains('"__reduce__"'),
        "large_strings": large_string_count(t, large_string_chars),
        "prefix_repeats": prefix_repeats(t),
    }
    raised = [
        ("dag_references", F.col("dag_references") > max_references, "POTENTIAL_CIRCULAR_REFS"),
        ("has_pickle", F.col("has_pickle"), "PICKLE_DETECTED"),
        ("task_references", F.col("task_references") > max_tasks, "EXCESSIVE_TASKS"),
        ("json_depth", F.col("json_depth") > max_depth, "DEEP_NESTING"),
        ("large_strings", F.col("large_strings") > 0, "LARGE_STRINGS"),
        ("prefix_repeats", F.col("prefix_repeats") > max_repeats, "REPETITIVE_PATTERNS"),
    ]
    taken = measures if only is None else {name: measures[name] for name in only}
    out = json_validity(documents, text=text).withColumns({name: F.when(valid, value) for name, value in taken.items()})
    rules = [(holds, issue) for name, holds, issue in raised if name in taken]
    return out.withColumn("issues", F.when(valid, labels_that_hold(*rules)))


def large_string_count(text: str | Column, min_chars: int = 10_240) -> Column:
    """Quoted strings of at least ``min_chars`` characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(t, F.lit(f'"[^"]{{{int(min_chars)},}}"')).cast("long")


def prefix_repeats(text: str | Column, *, max_prefix: int = 1000, min_prefix: int = 100) -> Column:
    """How often the text's beginning occurs in it; null for texts too short to tell."""
    t = F.col(text) if isinstance(text, str) else text
    size = F.least(F.lit(max_prefix), F.floor(F.length(t) / F.lit(10.0)).cast("int"))
    return F.when(size >= min_prefix, occurrences(t, F.substring(t, F.lit(1), size)))
