"""Database snapshots: table sizes, index use, locks and connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import first_label, percent, pretty_size
from ..functions.scale import salted_join, top_rows
from ..functions.timeexpr import AsOf, seconds_between, timestamp_lit


def storage_footprint(table_sizes: DataFrame, *, schema: str = "public", limit: int | None = 20) -> DataFrame:
    """Largest tables with their table and index parts."""
    sized = table_sizes.where(F.col("schemaname") == schema).withColumn(
        "indexes_size_bytes", F.col("total_size_bytes") - F.col("table_size_bytes")
    )
    return top_rows(sized, [F.desc("total_size_bytes"), F.asc("tablename")], limit).select(
        "schemaname",
        "tablename",
        pretty_size("total_size_bytes").alias("total_size"),
        "total_size_bytes",
        pretty_size("table_size_bytes").alias("table_size"),
        "table_size_bytes",
        pretty_size("indexes_size_bytes").alias("indexes_size"),
        "indexes_size_bytes",
    )


def storage_total(footprint: DataFrame, *, large_bytes: int = 1_000_000_000) -> DataFrame:
    """Total size and number of large tables of ``storage_footprint`` (one row); give it uncut for the whole schema."""
    return footprint.agg(
        F.round(F.sum("total_size_bytes") / F.lit(float(1024**3)), 2).alias("total_gb"),
        F.count_if(F.col("total_size_bytes") > large_bytes).alias("large_tables"),
    )


def index_usage(
    index_stats: DataFrame, *, schema: str = "public", large_bytes: int = 10_000_000, limit: int | None = 30
) -> DataFrame:
    """Least-scanned indexes first, larger ones before smaller, with unused flags."""
    unused = F.col("index_scans") == 0
    return top_rows(
        index_stats.where(F.col("schemaname") == schema),
        [F.asc("index_scans"), F.desc("index_size_bytes"), F.asc("tablename"), F.asc("indexname")],
        limit,
    ).select(
        "schemaname",
        "tablename",
        "indexname",
        "index_scans",
        "tuples_read",
        "tuples_fetched",
        pretty_size("index_size_bytes").alias("index_size"),
        "index_size_bytes",
        unused.alias("is_unused"),
        (unused & (F.col("index_size_bytes") > large_bytes)).alias("is_large_unused"),
    )


def lock_waits(activity: DataFrame, locks: DataFrame, *, as_of: AsOf, limit: int | None = 20) -> DataFrame:
    """Lock requests not granted and the queries that wait, oldest query first.

    Requests and queries both grow with the load, so neither side is broadcast, however small their files are.
    """
    waiting = locks.where(~F.col("granted")).select("pid", "locktype", "mode", "granted").hint("merge")
    busy = activity.where(F.col("state") != "idle")
    joined = salted_join(waiting, busy, ["pid"], ["locktype", "mode"]).select(
        "pid",
        "usename",
        "application_name",
        "state",
        "query",
        "wait_event_type",
        "wait_event",
        seconds_between(timestamp_lit(as_of), "query_start").alias("query_duration"),
        "locktype",
        "mode",
        "granted",
    )
    return top_rows(joined, [F.desc("query_duration"), F.asc("pid"), F.asc("locktype"), F.asc("mode")], limit)


def lock_status(waits: DataFrame) -> DataFrame:
    """Number of waiting queries and its label (one row)."""
    n = F.col("blocked_queries")
    return waits.agg(F.count(F.lit(1)).alias("blocked_queries")).withColumn(
        "status", first_label((n > 5, "Critical"), (n > 0, "Warning"), otherwise="Normal")
    )


def connection_stats(activity: DataFrame, *, as_of: AsOf) -> DataFrame:
    """Connections by state and their age (one row)."""
    state = F.col("state")
    age = seconds_between(timestamp_lit(as_of), "backend_start")
    return activity.agg(
        F.count(F.lit(1)).alias("total_connections"),
        F.count_if(state == "active").alias("active_connections"),
        F.count_if(state == "idle").alias("idle_connections"),
        F.count_if(state == "idle in transaction").alias("idle_in_transaction"),
        F.count_if(F.col("wait_event_type").isNotNull()).alias("waiting_connections"),
        F.max(age).alias("max_connection_age_seconds"),
        F.avg(age).alias("avg_connection_age_seconds"),
    )


def connection_status(stats: DataFrame, *, pool_size: int = 5, max_overflow: int = 10) -> DataFrame:
    """Pool use and idle-in-transaction alarms for ``connection_stats``."""
    use = percent("total_connections", F.lit(pool_size + max_overflow))
    return stats.select(
        "total_connections",
        use.alias("pool_percent"),
        first_label((use > 90, "Critical"), (use > 75, "Warning"), otherwise="Normal").alias("pool_status"),
        (F.col("idle_in_transaction") > 5).alias("has_idle_transactions"),
    )
