"""Windowed table export, document export and their reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_is_valid
from ..functions.timeexpr import AsOf, timestamp_lit
from .stored import missing_rows


@dataclass(frozen=True)
class ExportItem:
    """A table and the column its window is taken on (None: the whole table)."""

    table: str
    date_field: str | None


# fixed values: the small export list
CORE_EXPORT = [
    ExportItem("dag_run", "execution_date"),
    ExportItem("task_fail", "start_date"),
    ExportItem("task_instance", "start_date"),
    ExportItem("serialized_dag", "last_updated"),
]

# fixed values: the full export list
FULL_EXPORT = [
    ExportItem("dag_run", "execution_date"),
    ExportItem("task_instance", "start_date"),
    ExportItem("xcom", "execution_date"),
    ExportItem("task_instance_history", "start_date"),
    ExportItem("log", "dttm"),
    ExportItem("import_error", "timestamp"),
    ExportItem("dag", "last_parsed_time"),
    ExportItem("dag_code", "last_updated"),
    ExportItem("dag_version", "created_at"),
    ExportItem("variable", None),
    ExportItem("connection", None),
    ExportItem("slot_pool", None),
    ExportItem("dag_run_note", "created_at"),
    ExportItem("task_instance_note", "created_at"),
    ExportItem("asset_event", "timestamp"),
    ExportItem("asset", "created_at"),
    ExportItem("job", "start_date"),
    ExportItem("trigger", "created_date"),
    ExportItem("backfill", "created_at"),
    ExportItem("backfill_dag_run", None),
]

MAX_AGE_DAYS = 30


def export_catalog(spark: SparkSession, items: Sequence[ExportItem] = FULL_EXPORT) -> DataFrame:
    """The export list as a table, in its order."""
    rows = [(i, item.table, item.date_field) for i, item in enumerate(items, start=1)]
    return spark.createDataFrame(rows, "export_no int, table string, date_field string")


def cutoff_date(now: datetime, max_age_days: int = MAX_AGE_DAYS) -> str:
    return (now - timedelta(days=max_age_days)).strftime("%Y-%m-%d")


def export_window(
    df: DataFrame, date_field: str | None, now: datetime, *, max_age_days: int = MAX_AGE_DAYS, newest_first: bool = True
) -> DataFrame:
    """Rows from the cutoff day on, newest first.

    The comparison follows the column's type, so that it can reach the source: times and dates as such, text as text.
    Columns of other types, or none, are not filtered. Rows of one moment are ordered by their hash, which lets Spark
    split a moment that holds very many rows over several output files.
    """
    if date_field is None or date_field not in df.columns:
        return df
    kind, col = df.schema[date_field].dataType, F.col(date_field)
    cutoff = F.lit(cutoff_date(now, max_age_days))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        df = df.where(col >= cutoff.cast(kind))
    elif isinstance(kind, T.StringType):
        df = df.where(col >= cutoff)
    else:
        return df
    if not newest_first:
        return df
    nested = (T.MapType, T.ArrayType, T.StructType)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]
    return df.orderBy(col.desc(), F.xxhash64(*plain))


def csv_ready(df: DataFrame) -> DataFrame:
    """Columns CSV cannot hold as text: binary as base64, nested ones as JSON."""
    changes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BinaryType):
            changes[f.name] = F.base64(f.name)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            changes[f.name] = F.to_json(f.name)
    return df.withColumns(changes) if changes else df


def write_csv_gz(df: DataFrame, path: str) -> int:
    """Quoted, gzipped CSV with a header in every file; returns the rows written, counted while writing."""
    seen = Observation("rows written")
    (
        csv_ready(df)
        .observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("header", "true")
        .option("quoteAll", "true")
        .option("escape", '"')
        .option("compression", "gzip")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )
    return seen.get["rows"]


def output_folder(prefix: str, now: datetime) -> str:
    """``.../env`` to ``.../env-backups/yyyy/MM/dd``."""
    return f"{prefix.rstrip('/')}-backups/{now:%Y/%m/%d}"


def table_path(folder: str, table: str, now: datetime) -> str:
    return f"{folder}/{table}_{now:%H%M%S}.csv.gz"


def export_tables(
    tables: Mapping[str, DataFrame],
    items: Sequence[ExportItem],
    prefix: str,
    now: datetime,
    *,
    database: str = "",
    max_age_days: int = MAX_AGE_DAYS,
) -> dict[str, int]:
    """Writes the window of each listed table and a manifest; returns rows per table.

    Tables that are missing or have no rows in the window count 0 and write nothing.
    """
    folder = output_folder(prefix, now)
    counts: dict[str, int] = {}
    for item in items:
        counts[item.table] = 0
        if item.table not in tables:
            continue
        rows = export_window(tables[item.table], item.date_field, now, max_age_days=max_age_days, newest_first=False)
        if rows.isEmpty():
            continue
        rows = export_window(tables[item.table], item.date_field, now, max_age_days=max_age_days)
        counts[item.table] = write_csv_gz(rows, table_path(folder, item.table, now))
    if counts:
        spark = next(iter(tables.values())).sparkSession
        per_table = spark.createDataFrame(list(counts.items()), "table string, rows bigint")
        manifest = export_manifest(per_table, now, database=database, max_age_days=max_age_days)
        manifest.coalesce(1).write.mode("overwrite").option("compression", "gzip").json(
            f"{folder}/export_summary_{now:%H%M%S}.json.gz"
        )
    return counts


def export_counts(
    tables: Mapping[str, DataFrame], items: Sequence[ExportItem], now: datetime, *, max_age_days: int = MAX_AGE_DAYS
) -> DataFrame:
    """(table, rows) the export would write."""
    out = None
    for item in items:
        if item.table not in tables:
            continue
        rows = export_window(tables[item.table], item.date_field, now, max_age_days=max_age_days, newest_first=False)
        part = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(item.table).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("none of the listed tables was given")
    return out


def export_manifest(
    counts: DataFrame, now: datetime, *, database: str = "", max_age_days: int = MAX_AGE_DAYS
) -> DataFrame:
    """One row over (table, rows): totals and a map of rows per table (one entry per exported table)."""
    entries = F.array_sort(F.collect_list(F.struct("table", "rows")))
    return counts.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.sum("rows").alias("total_rows"),
        F.map_from_entries(entries).alias("tables"),
    ).select(
        F.lit(f"{now:%Y-%m-%d %H:%M:%S} UTC").alias("export_timestamp"),
        F.lit(database).alias("database_name"),
        F.lit(cutoff_date(now, max_age_days)).alias("cutoff_date"),
        F.lit(max_age_days).alias("max_age_days"),
        "total_tables",
        "total_rows",
        "tables",
    )


def latest_versions(documents: DataFrame) -> DataFrame:
    """The newest document per workflow; the limit also applies before the shuffle, so hot ids send one row a task."""
    newest = Window.partitionBy("dag_id").orderBy(F.desc("last_updated"), F.desc("dag_hash"))
    return documents.withColumn("_no", F.row_number().over(newest)).where(F.col("_no") == 1).drop("_no")


def export_documents(
    documents: DataFrame, *, as_of: AsOf, environment: str = "", version: str = "Unknown", include_metadata: bool = True
) -> DataFrame:
    """dag_id and the JSON text to store for it, on one line; valid documents are embedded as JSON, others as a string.

    Line breaks in valid JSON can only stand between its parts, so a space means the same.
    """
    one_line = F.translate("data", "\r\n", "  ")
    data = F.when(json_is_valid("data"), one_line).otherwise(_json_text(F.col("data")))
    data = F.coalesce(data, F.lit("null"))
    if not include_metadata:
        content = F.concat(F.lit('{"dag_id":'), _json_text(F.col("dag_id")), F.lit(',"serialized_data":'), data, F.lit("}"))
        return documents.select("dag_id", content.alias("content"))
    about_export = F.struct(
        F.date_format(timestamp_lit(as_of), "yyyy-MM-dd'T'HH:mm:ss").alias("exported_at"),
        F.lit("export_documents").alias("exported_by"),
        F.lit(environment).alias("source_environment"),
        F.lit(version).alias("source_version"),
    )
    about_document = F.struct(
        "dag_id",
        "fileloc",
        F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"),
        "dag_hash",
        "processor_subdir",
        F.coalesce(F.length("data"), F.lit(0)).alias("serialized_size_bytes"),
        F.coalesce(F.octet_length("data_compressed") > 0, F.lit(False)).alias("has_compressed_data"),
    )
    keep_nulls = {"ignoreNullFields": "false"}
    content = F.concat(
        F.lit('{"export_metadata":'),
        F.to_json(about_export, keep_nulls),
        F.lit(',"dag_metadata":'),
        F.to_json(about_document, keep_nulls),
        F.lit(',"serialized_data":'),
        data,
        F.lit("}"),
    )
    return documents.select("dag_id", content.alias("content"))


def _json_text(text: Column) -> Column:
    """A string as a JSON literal."""
    wrapped = F.to_json(F.array(text))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)


def write_documents(exported: DataFrame, path: str, *, compress: bool = True) -> None:
    """One folder per workflow (``dag_id=...``) with a JSON text per line."""
    writer = exported.write.mode("overwrite").partitionBy("dag_id")
    writer.option("compression", "gzip" if compress else "none").text(path)


def export_report(ids: DataFrame, exported: DataFrame) -> DataFrame:
    """Status (success or missing) and size per requested id."""
    done = exported.groupBy("dag_id").agg(F.sum(F.octet_length("content")).alias("file_size_bytes"))
    status = F.when(F.col("file_size_bytes").isNull(), "missing").otherwise("success")
    return ids.select("dag_id").distinct().join(done, "dag_id", "left").withColumn("status", status)


def export_report_summary(report: DataFrame) -> DataFrame:
    """Ids and bytes per status."""
    return report.groupBy("status").agg(
        F.count(F.lit(1)).alias("dags"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("total_bytes")
    )


def jdbc_append(df: DataFrame, url: str, table: str, properties: Mapping[str, str], *, keys: Sequence[str] = ()) -> None:
    """Appends rows to a database table.

    A failed append may have written some of its rows. With ``keys``, which tell rows apart, those that the table has
    already are left out, so that it can be repeated (``stored.append_batch`` does this for Parquet).
    """
    if keys:
        existing = df.sparkSession.read.jdbc(url, table, properties=dict(properties))
        df = missing_rows(df, existing, keys)
    df.write.jdbc(url, table, mode="append", properties=dict(properties))
