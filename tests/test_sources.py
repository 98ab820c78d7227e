"""Table readers and exports, written to and read back from temporary folders."""

from __future__ import annotations

import glob
import gzip
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from runscope.operators import inventory
from runscope.sources import export, listing, schemas, tables

from .conftest import as_dicts

NOW = datetime(2024, 2, 1, 13, 30, 5)


def test_every_schema_parses(spark):
    for name in schemas.SCHEMAS:
        assert schemas.schema_of(name).fields


def test_read_table_tries_names(spark, make):
    make("ab_role", [{"id": 1, "name": "A"}]).createOrReplaceTempView("tr_roles")
    assert tables.read_table(spark, "tr_roles").count() == 1
    assert tables.read_table(spark, "no_such_table") is None
    assert tables.name_variants("t") == ["t", "public.t", "airflow.t"]
    listed = [r["table_name"] for r in tables.list_tables(spark).collect()]
    assert "tr_roles" in listed and listed == sorted(listed)


def test_describe_probe_and_views(spark, make):
    docs = make("serialized_dag", [{"dag_id": "a", "data": "xyz"}] * 5)
    described = as_dicts(tables.describe_table(docs))
    assert described[0] == {"ordinal_position": 1, "column_name": "dag_id", "data_type": "string", "is_nullable": "YES"}
    probe = as_dicts(tables.sample_probe(docs, ["dag_id", "data", "data_compressed"]))
    assert len(probe) == 3 and probe[0]["data_length"] == 3 and probe[0]["data_compressed_type"] == "binary"
    assert tables.register_views({n: make(n, []) for n in tables.RBAC_TABLES}) == tables.RBAC_TABLES
    assert spark.sql("select * from ab_permission_view_role").count() == 0


def test_conform_casts_plain_times(spark, tmp_path):
    path = str(tmp_path)
    spark.sql("select 'd' as dag_id, timestamp_ntz '2024-01-01 00:00:00' as execution_date, 1 as extra").write.parquet(f"{path}/dag_run")
    read = tables.read_parquet_tables(spark, path, ["dag_run"])["dag_run"]
    assert dict(read.dtypes) == {"dag_id": "string", "execution_date": "timestamp", "extra": "int"}


def test_select_by_ids(spark, make):
    docs = make("serialized_dag", [{"dag_id": "a", "data": "xx"}, {"dag_id": "b", "data": "y"}])
    ids = tables.requested_ids(spark, " a, missing ,,a")
    found, missing = tables.select_by_ids(docs, ids)
    assert [(r["dag_id"], r["size_bytes"]) for r in found.collect()] == [("a", 2)]
    assert [r["dag_id"] for r in missing.collect()] == ["missing"]
    with pytest.raises(ValueError):
        tables.requested_ids(spark, " , ")
    with pytest.raises(ValueError):
        tables.require_found(tables.select_by_ids(docs, tables.requested_ids(spark, "z"))[0])


def test_file_inventory(spark, tmp_path):
    for name, size in (("a.py", 3), ("sub/b.csv", 5), ("sub/.hidden", 7), ("__pycache__/c.pyc", 9), ("__init__.py", 1), ("_lib/_private.py", 2)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * size)
    got = {r["path"]: r["size_bytes"] for r in tables.file_inventory(spark, str(tmp_path)).collect()}
    assert got["sub/.hidden"] == 7 and got["__pycache__/c.pyc"] == 9
    seen = inventory.visible_files(tables.file_inventory(spark, str(tmp_path))).collect()
    assert {r["path"]: r["size_bytes"] for r in seen} == {"a.py": 3, "sub/b.csv": 5, "__init__.py": 1, "_lib/_private.py": 2}


@pytest.mark.parametrize("budget", [50, 1_000_000])
def test_a_large_tree_is_listed_in_rounds(spark, tmp_path, budget):
    """10,000 files, deep and wide, hidden names among them; the same whatever a task may walk in one round."""
    names = [f"{'/'.join(f'{p}{i % k}' for p, k in (('a', 7), ('_b', 5), ('.c', 3)))}/f{i}.py" for i in range(9_000)]
    names += [f"wide/_{i}.txt" for i in range(900)] + ["/".join(["deep"] * d) + "/x.py" for d in range(1, 101)]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * (len(name) % 5))
    (tmp_path / "empty").mkdir()
    (tmp_path / "a0" / "loop").symlink_to(tmp_path)
    rows = listing.list_tree(spark, str(tmp_path), budget=budget).collect()
    assert sorted((r.path, r.size_bytes) for r in rows) == sorted((n, len(n) % 5) for n in names)


def test_listing_what_is_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        listing.list_tree(spark, str(tmp_path / "none"))
    assert listing.list_tree(spark, str(tmp_path)).count() == 0
    assert {r.path for r in listing._by_driver(spark, "/root/testdata/sf0.001").collect()} == {
        r.path for r in listing.list_tree(spark, "/root/testdata/sf0.001").collect()
    }


def test_window_by_type(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-03 10:00:00"]
    df = spark.createDataFrame([(d,) for d in days], "text string").select(
        "text",
        F.col("text").cast("timestamp").alias("ts"),
        F.col("text").cast("timestamp_ntz").alias("ntz"),
        F.to_date("text").alias("day"),
        F.lit(1).alias("number"),
    )
    at = datetime(2024, 2, 1, 12)
    for column in ("text", "ts", "ntz", "day"):
        kept = [r["text"] for r in export.export_window(df, column, at).collect()]
        assert kept == ["2024-01-03 10:00:00", "2024-01-02"], column
    for column in ("number", None, "missing"):
        assert export.export_window(df, column, at).count() == 3


def test_csv_round_trip(spark, make, tmp_path):
    rows = [{"dag_id": 'quote " and, comma', "data": "line\nbreak", "data_compressed": bytearray(b"\x00\x01"), "last_updated": "2024-01-01 00:00:01.500000"}, {"dag_id": "b"}]
    path = str(tmp_path / "csv")
    assert export.write_csv_gz(make("serialized_dag", rows), path) == 2
    files = glob.glob(f"{path}/part-*.csv.gz")
    assert files
    text = "".join(gzip.open(f, "rt").read() for f in files)
    assert '"dag_id","fileloc"' in text and '"quote "" and, comma"' in text and '"2024-01-01 00:00:01.500000"' in text
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    got = {r["dag_id"]: (r["data"], r["data_compressed"]) for r in back.collect()}
    assert got['quote " and, comma'] == ("line\nbreak", "AAE=")


def test_layout():
    assert export.output_folder("s3://b/exports/env/", NOW) == "s3://b/exports/env-backups/2024/02/01"
    assert export.table_path("p", "dag_run", NOW) == "p/dag_run_133005.csv.gz"
    assert export.cutoff_date(NOW) == "2024-01-02"
    assert len(export.CORE_EXPORT) == 4 and len(export.FULL_EXPORT) == 20


def test_export_tables(spark, make, tmp_path):
    data = {
        "dag_run": make("dag_run", [{"dag_id": "a", "execution_date": f"2024-01-{d:02d} 00:00:00"} for d in (1, 5, 9)]),
        "task_fail": make("task_fail", [{"dag_id": "old", "start_date": "2020-01-01 00:00:00"}]),
        "slot_pool": make("slot_pool", [{"pool": "p", "slots": 1}]),
    }
    items = [*export.CORE_EXPORT[:2], export.ExportItem("slot_pool", None), export.ExportItem("absent", "x")]
    counts = export.export_tables(data, items, str(tmp_path / "env"), NOW, database="meta")
    assert counts == {"dag_run": 2, "task_fail": 0, "slot_pool": 1, "absent": 0}
    folder = str(tmp_path / "env-backups/2024/02/01")
    newest = spark.read.option("header", True).csv(f"{folder}/dag_run_133005.csv.gz")
    assert {r["execution_date"][:10] for r in newest.collect()} == {"2024-01-05", "2024-01-09"}
    assert not glob.glob(f"{folder}/task_fail*") and not glob.glob(f"{folder}/absent*")
    (file,) = glob.glob(f"{folder}/export_summary_133005.json.gz/part-*.json.gz")
    manifest = json.loads(gzip.open(file, "rt").read())
    assert (manifest["total_tables"], manifest["total_rows"], manifest["tables"]["dag_run"]) == (4, 3, 2)
    assert manifest["cutoff_date"] == "2024-01-02" and manifest["database_name"] == "meta"


def test_export_documents(spark, make, tmp_path):
    rows = [
        {"dag_id": "a", "data": '{"k": [1]}', "last_updated": "2024-01-02 00:00:00", "dag_hash": "h", "data_compressed": bytearray(b"x")},
        {"dag_id": "a", "data": "{}", "last_updated": "2024-01-01 00:00:00"},
        {"dag_id": "b", "data": 'not "json"', "last_updated": "2024-01-01 00:00:00"},
        {"dag_id": "c"},
    ]
    latest = export.latest_versions(make("serialized_dag", rows))
    exported = export.export_documents(latest, as_of=NOW, environment="prod")
    got = {r["dag_id"]: json.loads(r["content"]) for r in exported.collect()}
    assert got["a"]["serialized_data"] == {"k": [1]} and got["a"]["dag_metadata"]["has_compressed_data"] is True
    assert got["a"]["export_metadata"]["source_environment"] == "prod" and got["a"]["dag_metadata"]["fileloc"] is None
    assert got["b"]["serialized_data"] == 'not "json"' and got["c"]["serialized_data"] is None
    bare = export.export_documents(latest, as_of=NOW, include_metadata=False)
    assert json.loads(bare.where("dag_id = 'a'").first()["content"]) == {"dag_id": "a", "serialized_data": {"k": [1]}}
    export.write_documents(exported, str(tmp_path / "docs"))
    assert len(glob.glob(f"{tmp_path}/docs/dag_id=a/*.gz")) == 1
    report = export.export_report(tables.requested_ids(spark, "a,b,zz"), exported)
    assert {r["dag_id"]: r["status"] for r in report.collect()} == {"a": "success", "b": "success", "zz": "missing"}
    assert {r["status"]: r["dags"] for r in export.export_report_summary(report).collect()} == {"success": 2, "missing": 1}


def test_export_catalog(spark):
    rows = as_dicts(export.export_catalog(spark))
    assert len(rows) == 20 and rows[0] == {"export_no": 1, "table": "dag_run", "date_field": "execution_date"}
    assert date.fromisoformat(export.cutoff_date(NOW)) == date(2024, 1, 2)
