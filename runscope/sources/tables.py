"""Reading tables by name, and looking at what is there."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import salted_join
from .listing import list_tree
from .schemas import SCHEMAS, schema_of
from .stored import range_predicates

# fixed values: schemas tried in this order when a table name has none
SCHEMA_ORDER = ["", "public", "airflow"]

# fixed values: schemas that hold no user tables
SYSTEM_SCHEMAS = ["information_schema", "pg_catalog"]

# fixed values: tables needed to derive roles
RBAC_TABLES = ["ab_role", "ab_permission", "ab_view_menu", "ab_permission_view", "ab_permission_view_role"]


def name_variants(name: str, schemas: Sequence[str] = SCHEMA_ORDER) -> list[str]:
    return [f"{s}.{name}" if s else name for s in schemas]


def read_table(spark: SparkSession, name: str, schemas: Sequence[str] = SCHEMA_ORDER) -> DataFrame | None:
    """The first catalog table found under the name variants, or None."""
    for variant in name_variants(name, schemas):
        if spark.catalog.tableExists(variant):
            return spark.table(variant)
    return None


def read_parquet_tables(spark: SparkSession, base_path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """``<base_path>/<name>`` per table; columns of known tables are cast to their declared types."""
    return {name: conform(spark.read.parquet(f"{base_path}/{name}"), name) for name in names}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Casts the columns of a known table to their declared types; other columns stay as they are."""
    if table not in SCHEMAS:
        return df
    wanted = {f.name: f.dataType for f in schema_of(table).fields}
    changes = {
        f.name: F.col(f.name).cast(wanted[f.name])
        for f in df.schema.fields
        if f.name in wanted and f.dataType != wanted[f.name]
    }
    return df.withColumns(changes) if changes else df


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    name: str,
    properties: Mapping[str, str],
    *,
    schemas: Sequence[str] = SCHEMA_ORDER,
    partition_column: str | None = None,
    lower: str | int | None = None,
    upper: str | int | None = None,
    partitions: int = 64,
    bounds: Sequence | None = None,
) -> DataFrame | None:
    """A database table read in parallel ranges of ``partition_column``; None if no variant exists.

    The name is settled by one query on the database's own catalog. ``lower`` and ``upper`` place ranges of equal width,
    ``bounds`` (as from ``stored.equi_depth_bounds`` or ``stored.bounds_query``) ranges of their own, for skewed ids; rows
    outside them are read too. Later filters and column choices reach the database.
    """
    found = _jdbc_name(spark, url, name, properties, schemas)
    if found is None:
        return None
    if partition_column is None:
        return spark.read.jdbc(url, found, properties=dict(properties))
    if bounds is not None:
        predicates = range_predicates(partition_column, sorted(bounds))
        return spark.read.jdbc(url, found, predicates=predicates, properties=dict(properties))
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=found,
        partitionColumn=partition_column,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
        **properties,
    )
    return reader.load()


def _jdbc_name(
    spark: SparkSession, url: str, name: str, properties: Mapping[str, str], schemas: Sequence[str]
) -> str | None:
    wanted = sorted({"public", *schemas} - {""})
    known = jdbc_tables(spark, url, properties).where(
        (F.lower("table_name") == name.lower()) & F.col("table_schema").isin(*wanted)
    )
    places = {row["table_schema"] for row in known.select("table_schema").distinct().collect()}
    for schema in schemas:
        if schema in places or (schema == "" and "public" in places):
            return f"{schema}.{name}" if schema else name
    return None


def jdbc_tables(spark: SparkSession, url: str, properties: Mapping[str, str]) -> DataFrame:
    """(table_schema, table_name) of a database's base tables, system schemas left out."""
    query = "select table_schema, table_name from information_schema.tables where table_type = 'BASE TABLE'"
    tables = spark.read.format("jdbc").options(url=url, query=query, **properties).load()
    return tables.where(~F.col("table_schema").isin(*SYSTEM_SCHEMAS)).orderBy("table_schema", "table_name")


def list_tables(spark: SparkSession) -> DataFrame:
    """(table_schema, table_name) of the catalog's tables and views, sorted; temporary views have an empty schema."""
    rows = [
        ((t.namespace or [""])[-1], t.name)
        for db in spark.catalog.listDatabases()
        if db.name not in SYSTEM_SCHEMAS
        for t in spark.catalog.listTables(db.name)
    ]
    listed = spark.createDataFrame(rows, "table_schema string, table_name string")
    return listed.distinct().orderBy("table_schema", "table_name")


def describe_table(df: DataFrame) -> DataFrame:
    """column_name, data_type, is_nullable in column order."""
    rows = [(i, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for i, f in enumerate(df.schema, start=1)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal_position int, column_name string, data_type string, is_nullable string"
    ).orderBy("ordinal_position")


def sample_probe(df: DataFrame, columns: Sequence[str], *, rows: int = 3, order: Sequence[str] = ()) -> DataFrame:
    """A few rows: the first column, then text length and type of the others.

    Any rows, or the first ones by the columns of ``order``.
    """
    first, *others = columns
    probes = []
    for c in others:
        probes.append(F.length(F.col(c).cast("string")).alias(f"{c}_length"))
        probes.append(F.typeof(c).alias(f"{c}_type"))
    return (df.orderBy(*order) if order else df).select(first, *probes).limit(rows)


def register_views(tables: Mapping[str, DataFrame], names: Iterable[str] = RBAC_TABLES) -> list[str]:
    """Makes the tables visible to ``spark.sql`` and returns their names."""
    registered = []
    for name in names:
        tables[name].createOrReplaceTempView(name)
        registered.append(name)
    return registered


def requested_ids(spark: SparkSession, id_list: str) -> DataFrame:
    """A comma-separated list as distinct, trimmed ids; raises if it has none."""
    ids = sorted({part.strip() for part in id_list.split(",")} - {""})
    if not ids:
        raise ValueError("no ids given")
    return spark.createDataFrame([(i,) for i in ids], "dag_id string")


def select_by_ids(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Size and version of the documents asked for, and the ids without one.

    Texts are measured before the join, so they are not shuffled.
    """
    wanted = ids.select("dag_id").distinct()
    size = F.length("data")
    measured = documents.select(
        "dag_id",
        "fileloc",
        size.alias("size_bytes"),
        F.round(size / F.lit(1048576.0), 2).alias("size_mb"),
        "last_updated",
        "dag_hash",
    )
    found = salted_join(measured, wanted, ["dag_id"], ["dag_hash", "last_updated"], "left_semi")
    return found, wanted.join(documents.select("dag_id").distinct(), "dag_id", "left_anti")


def require_found(found: DataFrame) -> DataFrame:
    """``found``, or an error if it is empty."""
    if found.isEmpty():
        raise ValueError("none of the requested ids exist")
    return found


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative to ``folder``) and size_bytes of all files below it; contents are not read.

    Spark's file sources leave out names that begin with an underscore or a dot, so the tree is listed by ``list_tree``,
    in tasks. Which names count is up to ``inventory.visible_files``.
    """
    return list_tree(spark, folder)
