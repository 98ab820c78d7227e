"""Document operators and text expressions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from runscope.functions import numeric, text, timeexpr
from runscope.operators import documents
from runscope.sources import export

from .conftest import as_dicts


def docs(make, *texts, **more):
    rows = [{"dag_id": f"d{i}", "fileloc": f"/f{i}", "data": t, "last_updated": "2024-01-05 12:00:00", "dag_hash": f"h{i}", **more} for i, t in enumerate(texts)]
    return make("serialized_dag", rows)


def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


JSON_TEXTS = [
    "{}", "[]", "[[]]", '{"a": 1}', '{"a": {"b": [1, [2]]}}', '{"a": "}]{\\""}', "1", '"x"', "null", ' {"a" : [ ] } ',
    '{"a": 1, "a": 2}', '{"q": "it\'s"}', '[{"a": "\\\\"}, {"b": [{}]}]', '{"é": "ü\\u00e9"}',
]
BAD_TEXTS = [
    "", "{", "[1, 2", '{"a": 1} x', "1, 2", "1],[2", '{"a": 01}', "{'a': 1}", '{"a": "b\nc"}', '{"a": "b\tc"}', "text", '{"a"}',
    '{"v": 1},{"v": 2}', '"a" "b"', "[1,]", '"', '\\"',
]


def test_json_validity(spark):
    for t in JSON_TEXTS:
        json.loads(t)
    for t in BAD_TEXTS:
        with pytest.raises(json.JSONDecodeError):
            json.loads(t)
    assert evaluate(spark, JSON_TEXTS + BAD_TEXTS, text.json_is_valid) == [True] * len(JSON_TEXTS) + [False] * len(BAD_TEXTS)


def depth(value, level=0):
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return max((depth(v, level + 1) for v in inner), default=level)


def test_json_depth(spark):
    deep = ["[" * n + "1" + "]" * n for n in (20, 21, 300)]
    assert evaluate(spark, JSON_TEXTS + deep, text.json_depth) == [depth(json.loads(t)) for t in JSON_TEXTS + deep]


def test_json_beyond_the_usual_limits(spark):
    deep = ["[" * n + "]" * n for n in (999, 1000, 1001, 5000)] + ['{"a":' * 5000 + "1" + "}" * 5000]
    numbers = ["1" * 1200, "[0." + "3" * 4000 + "]"]
    bad = ["[" * 5000 + "]" * 4999, "[" * 1500 + "]" * 1501, '{"a":' * 1500 + "}" * 1500, "1" * 1200 + "."]
    assert evaluate(spark, deep + numbers + bad, text.json_is_valid) == [True] * 7 + [False] * 4
    assert evaluate(spark, deep, text.json_depth) == [998, 999, 1000, 4999, 5000]


def test_deep_documents_are_checked_and_exported_as_json(make):
    deep = "[" * 1500 + "1" + "]" * 1500
    row = documents.content_checks(docs(make, deep)).first()
    assert (row["json_valid"], row["json_depth"], row["issues"]) == (True, 1500, ["DEEP_NESTING"])
    exported = export.export_documents(docs(make, deep), as_of="2024-01-01", include_metadata=False).first()
    assert exported["content"].endswith(f'"serialized_data":{deep}}}')


def test_long_strings_do_not_overflow(spark):
    long = json.dumps({"a": "x" * 300_000 + '\\"' * 50_000, "b": [[1]]})
    assert evaluate(spark, [long], text.json_is_valid) == [True]
    assert evaluate(spark, [long], text.json_depth) == [3]


def test_content_checks(make):
    def one(t, **limits):
        return documents.content_checks(docs(make, t), **limits).first()

    many = json.dumps(["_dag"] * 11)
    assert one(many)["issues"] == ["POTENTIAL_CIRCULAR_REFS"] and one(json.dumps(["_dag"] * 10))["issues"] == []
    assert one('{"pickle": 1}')["issues"] == ["PICKLE_DETECTED"] == one('["__reduce__"]')["issues"]
    assert one(json.dumps([{"task_id": 1}] * 1001))["task_references"] == 1001
    assert "EXCESSIVE_TASKS" in one(json.dumps([{"task_id": 1}] * 1001))["issues"]
    assert one("[" * 21 + "]" * 21)["json_depth"] == 20 and "DEEP_NESTING" in one("[" * 21 + "1" + "]" * 21)["issues"]
    assert one(json.dumps("x" * 10_240))["issues"] == ["LARGE_STRINGS"] and one(json.dumps("x" * 10_239))["issues"] == []
    bad = one("[")
    assert (bad["json_valid"], bad["json_depth"], bad["issues"]) == (False, None, None)


@pytest.mark.parametrize(("repeats", "issue"), [(5, []), (6, ["REPETITIVE_PATTERNS"])])
def test_repeated_prefix(spark, make, repeats, issue):
    # 2100 characters, so the beginning is 210 characters long
    unit = '"' + "".join(chr(97 + i % 26) + str(i) for i in range(80))[:209]
    body = unit * repeats
    t = body + "".join(str(i % 7) for i in range(2100 - len(body)))
    assert evaluate(spark, [t], documents.prefix_repeats) == [repeats]
    assert evaluate(spark, ["short"], documents.prefix_repeats) == [None]
    listed = "[" + ",".join(['{"k":"' + "z" * 100 + '"}'] * 12) + "]"
    assert documents.content_checks(docs(make, listed)).first()["prefix_repeats"] == 1


def test_profile_and_status(make):
    big = '{"task_id": 1, "op": "BashOperator", "retries": 1}' + "x" * 6_000_000
    rows = docs(make, big, '{"x": "GlueS3 sla"}', "é" * 10, None)
    rows = rows.withColumn("data_compressed", F.when(F.col("dag_id") == "d1", F.encode(F.lit("zz"), "UTF-8")))
    profile = documents.document_size_profile(rows, as_of="2024-01-07 11:00:00")
    got = {r["dag_id"]: r for r in profile.collect()}
    assert set(got) == {"d0", "d1", "d2"}
    assert (got["d0"]["estimated_task_count"], got["d0"]["primary_operator_type"], got["d0"]["complexity_indicators"]) == (1, "BashOperator", "Has Retries")
    assert (got["d1"]["primary_operator_type"], got["d1"]["complexity_indicators"]) == ("S3Operations", "Has SLA")
    assert (got["d1"]["compression_status"], got["d1"]["storage_size_bytes"], got["d1"]["days_since_update"]) == ("Compressed", 2, 1)
    assert (got["d2"]["serialized_size_bytes"], got["d2"]["total_length"]) == (20, 10)
    status = {r["dag_id"]: r for r in documents.document_size_status(profile).collect()}
    assert (status["d0"]["issues"], status["d0"]["status"], status["d0"]["size_bucket"]) == (["LARGE_SIZE", "LARGE_WITH_FEW_TASKS"], "Warning", ">5MB")
    assert (status["d1"]["issues"], status["d1"]["status"]) == ([], "Normal")
    summary = documents.document_size_summary(documents.document_size_status(profile)).first()
    assert (summary["total_dags"], summary["suspicious_dags"]) == (3, 1)
    assert [r["dag_id"] for r in documents.document_size_profile(rows, as_of="2024-01-07", top_n=2).collect()] == ["d0", "d1"]


@pytest.mark.parametrize(
    ("mb", "issues", "status"),
    [
        (5, [], "Normal"),
        (5.01, ["LARGE_SIZE"], "Warning"),
        (10, ["LARGE_SIZE"], "Warning"),
        (10.01, ["CRITICAL_SIZE", "LARGE_SERIALIZATION"], "Critical"),
        (20.01, ["CRITICAL_SIZE", "VERY_LARGE"], "Critical"),
        (50.01, ["CRITICAL_SIZE", "EXTREMELY_LARGE"], "Critical"),
    ],
)
def test_size_limits(spark, mb, issues, status):
    profile = spark.createDataFrame([("d", "/f", int(mb * 1048576), float(mb), 10)], "dag_id string, fileloc string, serialized_size_bytes long, serialized_size_mb double, estimated_task_count long")
    row = documents.document_size_status(profile).first()
    assert (row["issues"], row["status"]) == (issues, status)


def test_instability_and_updates(make):
    def versions(n, dag):
        return [{"dag_id": dag, "data": "x" * (i + 1), "dag_hash": f"{dag}{i}", "last_updated": f"2024-01-05 00:{i:02d}:00"} for i in range(n)]

    table = make("serialized_dag", versions(3, "a") + versions(4, "b") + versions(6, "c"))
    assert [r["dag_id"] for r in documents.serialization_instability(table, as_of="2024-01-08").collect()] == ["c", "b"]
    assert [r["dag_id"] for r in documents.frequent_updates(table, as_of="2024-01-08").collect()] == ["c"]
    assert documents.frequent_updates(table, as_of="2024-01-08", versions=5).count() == 0
    plan = documents.frequent_updates(table, as_of="2024-01-08")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_structure_and_risk(make):
    counts = documents.structure_counts(docs(make, "{[}", "[[]", "{}"))
    assert [r["issues"] for r in counts.orderBy("dag_id").collect()] == [["UNBALANCED_BRACKETS"], ["UNBALANCED_BRACKETS"], []]
    assert as_dicts(documents.issue_breakdown(counts)) == [{"issue": "UNBALANCED_BRACKETS", "dags": 2}]
    assert documents.suspicious_summary(counts).first()["total_suspicious"] == 2
    assert documents.structure_counts(docs(make, "{" * 10_001)).first()["issues"] == ["UNBALANCED_BRACES", "DEEP_NESTING"]
    assert [r["risk"] for r in documents.document_risk(documents.structure_counts(docs(make, "x" * 600)), unit_bytes=1024).collect()] == ["MEDIUM"]


def test_histograms(make):
    profile = documents.document_size_profile(docs(make, "x", "x" * 60_000), as_of="2024-01-07")
    assert [(r["bucket"], r["dags"]) for r in documents.size_histogram(profile).collect()][:2] == [("<50KB", 1), ("50-500KB", 1)]
    assert sum(r["dags"] for r in documents.size_histogram(profile, variant="kb").collect()) == 2
    with pytest.raises(ValueError):
        documents.size_histogram(profile, variant="gb")


def test_small_expressions(spark):
    sizes = [0, 10_239, 10_240, 10_485_247, 10_485_248, 10_737_418_240]
    assert evaluate(spark, sizes, numeric.pretty_size, "long") == ["0 bytes", "10239 bytes", "10 kB", "10239 kB", "10 MB", "10 GB"]
    assert evaluate(spark, ["a" * 42, "a" * 43], lambda c: text.shorten_end(c, 42)) == ["a" * 42, "a" * 39 + "..."]
    assert evaluate(spark, ["/x" * 24], lambda c: text.shorten_start(c, 47)) == ["..." + ("/x" * 24)[-44:]]
    assert evaluate(spark, ["[a, b]", "a"], text.group_list) == [["a", "b"], ["a"]]
    paths = ["a/b.tar.GZ", "a/.hidden", "a/noext", "x.d/noext", "..rc.py", "end."]
    assert evaluate(spark, paths, text.file_extension) == [".gz", "no_extension", "no_extension", "no_extension", ".py", "."]
    assert evaluate(spark, [59.0, 3599.0, 3600.0, 5400.0], timeexpr.duration_label, "double") == ["1.0m", "60.0m", "1.0h", "1.5h"]
    url = ["postgresql://u:p@h:6000/db?x=1", "postgresql://u:p@h"]
    got = evaluate(spark, url, text.connection_parts)
    assert [tuple(g) for g in got] == [("u", "h", 6000, "db"), ("u", "h", 5432, "airflow")]
    assert evaluate(spark, ["aaaa", "a.a"], lambda c: text.occurrences(c, "aa")) == [2, 0]


def test_depth_takes_no_step_per_bracket_in_the_plan(spark):
    """Folding over single brackets, interpreted, took a microsecond each."""
    texts = ["[" * 3000 + "[1,{}],[{\"a}\\\"]\":[ ]}]" + "]" * 3000, "[" * (3 << 20) + "1" + "]" * (3 << 20), "1", None]
    assert evaluate(spark, texts, text.json_depth) == [3002, 3 << 20, 0, None]
    plan = spark.range(1).select(text.json_depth(F.lit("1")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_content_checks_of_some_measures(make):
    found = documents.content_checks(docs(make, '[["pickle"]]', "["), max_depth=1, only=["json_depth"]).orderBy("dag_id").collect()
    assert [(r["json_valid"], r["json_depth"], r["issues"]) for r in found] == [(True, 2, ["DEEP_NESTING"]), (False, None, None)]
    assert "has_pickle" not in found[0]


def test_issue_breakdown_makes_the_issues_once(make):
    """No filter in front of the array may repeat what it is made of."""
    counted = documents.issue_breakdown(documents.content_checks(docs(make, "[[1]]", "{", '{"a":"pickle","pickle":1}'), max_depth=1))
    assert [tuple(r) for r in counted.collect()] == [("DEEP_NESTING", 1), ("PICKLE_DETECTED", 1)]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2


def test_pretty_size_beyond_doubles(spark):
    assert evaluate(spark, [21 * 2**49 - 1, 21 * 2**49], numeric.pretty_size, "long") == ["10 PB", "11 PB"]
