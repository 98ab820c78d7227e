"""Changing stored Parquet tables: batches that may be appended again, and tables in hash buckets whose changes rewrite only
the buckets they meet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settle import settled

#: Names that begin with an underscore are left out by Spark when it reads the table around them.
LEDGER = "_ledger"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, rows) of the batches that are complete."""
    kind = "batch_id string, rows bigint"
    if not _exists(spark, f"{path}/{LEDGER}"):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{path}/{LEDGER}").distinct()


def append_batch(df: DataFrame, path: str, batch_id: str) -> bool:
    """Appends a batch to the table at ``path`` unless the ledger has it; returns whether it was written.

    The batch is written to a folder of its own and entered in the ledger afterwards. A run that failed before that can be
    repeated: it replaces what the failed one left. A run after that does nothing.
    """
    spark = df.sparkSession
    if not committed_batches(spark, path).where(F.col("batch_id") == batch_id).isEmpty():
        return False
    folder = f"{path}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(folder)
    rows = spark.read.schema(df.schema).parquet(folder).count()
    entry = spark.createDataFrame([(batch_id, rows)], "batch_id string, rows bigint")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/{LEDGER}")
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all complete batches, with their ``batch_id``; what a failed run left is not seen."""
    table = spark.read.option("basePath", path).option("mergeSchema", "false").parquet(path)
    table = table.withColumn("batch_id", F.col("batch_id").cast("string"))
    return table.join(committed_batches(spark, path).select("batch_id"), "batch_id", "left_semi")


def missing_rows(df: DataFrame, existing: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``existing`` yet, each key once: what a repeated append has left to write."""
    keys = list(keys)
    return df.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*df.columns)


BUCKET = "bucket"


def _bucket(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Stores a table in folders by the hash of ``key``. A bucket may be written by several tasks, so a hot one is no limit."""
    df.withColumn(BUCKET, _bucket(key, buckets)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def apply_changes(
    spark: SparkSession, path: str, key: str, rows: DataFrame, gone: DataFrame | None = None, buckets: int = 64
) -> list[int]:
    """Replaces all rows of the keys in ``rows`` by these rows, drops those of the keys in ``gone`` (a column of ``key``), and
    returns the numbers of the buckets rewritten.

    Only buckets that a changed key hashes to are read and written; other folders stay as they are. ``buckets`` must be the
    number the table was stored with. The new contents are settled in the checkpoint folder before anything is replaced.
    Applying the same changes again changes nothing. Changes to one table must not run at the same time.
    """
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != BUCKET]
    rows = settled(rows.select(*columns))
    keys = rows.select(key)
    if gone is not None:
        keys = keys.unionByName(gone.select(key))
    keys = settled(keys.distinct().withColumn(BUCKET, _bucket(key, buckets)))
    # bounded by the number of buckets
    touched = sorted(r[0] for r in keys.select(BUCKET).distinct().collect())
    if not touched:
        return []
    same = F.col("old.key").eqNullSafe(F.col("new.key"))
    old = stored.where(F.col(BUCKET).isin(touched)).select(F.col(key).alias("key"), F.struct(*columns).alias("row"), BUCKET)
    kept = old.alias("old").join(keys.select(F.col(key).alias("key")).alias("new"), same, "left_anti")
    after = kept.select("row.*", BUCKET).unionByName(rows.withColumn(BUCKET, _bucket(key, buckets)))
    after = settled(after)
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    # a bucket without rows is not written, so its folder goes
    filled = {r[0] for r in after.select(BUCKET).distinct().collect()}
    for number in touched:
        if number not in filled:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={number}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return touched


def equi_depth_bounds(df: DataFrame, column: str, parts: int, accuracy: int = 10_000) -> list:
    """At most ``parts - 1`` values that cut a column into ranges of about the same number of rows.

    One aggregate of bounded size; ``accuracy`` is the reciprocal of its rank error. A value that fills several ranges by
    itself gives one range.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, shares, accuracy)).first()[0]
    least = df.agg(F.min(column)).first()[0]
    return sorted({v for v in found or [] if v is not None and v > least})


def range_predicates(column: str, bounds: list) -> list[str]:
    """SQL conditions that cut a table at ``bounds``; every row meets exactly one, nulls the first."""

    def literal(v) -> str:
        return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    if not bounds:
        return ["1 = 1"]
    first = f"({column} < {literal(bounds[0])} OR {column} IS NULL)"
    inner = [f"{column} >= {literal(a)} AND {column} < {literal(b)}" for a, b in zip(bounds, bounds[1:])]
    return [first, *inner, f"{column} >= {literal(bounds[-1])}"]


def bounds_query(table: str, column: str, parts: int, rows: int) -> str:
    """SQL for a database to find split points: the cuts of a sample of about 10,000 rows of a table of ``rows`` rows.

    The sample goes by the remainder of the id, so that it follows the skew of the ids; the database returns one row for each
    range.
    """
    every = max(1, rows // 10_000)
    sample = f"SELECT {column} AS v, NTILE({int(parts)}) OVER (ORDER BY {column}) AS part FROM {table} WHERE MOD({column}, {every}) = 0"
    return f"SELECT MIN(v) AS bound FROM ({sample}) s GROUP BY part ORDER BY 1"
