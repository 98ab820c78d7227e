"""Document and text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runscope.functions.numeric import pretty_size
from runscope.functions.text import connection_parts, shorten_end, shorten_start
from runscope.operators import documents

from .q_runs import EVENT
from .register import EVENTS_AS_OF, EVENTS_DAYS, Get, big, query, rnd, within

# fixed values: markers that occur in the given texts (the defaults do not)
TYPES = [("License", "LicenseText"), ("http", "LinkText"), ("@", "AddressText")]
KINDS = [("the", "English"), ("der", "German"), ("que", "French")]


def _first(column: str, labels: list[tuple[str, str]], other: str) -> str:
    cases = " ".join(f"WHEN contains({column}, '{m}') THEN '{label}'" for m, label in labels)
    return f"CASE {cases} ELSE '{other}' END"


def _occurrences(column: str, part: str) -> str:
    return big(f"(length({column}) - length(replace({column}, '{part}', ''))) / length('{part}')")


SIZE = "strlen(data)"
STORED = "CASE WHEN octet_length(data_compressed) > 0 THEN octet_length(data_compressed) ELSE strlen(data) END"
AGE = f"floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(last_updated)) / 1e6 / 86400)"
PROFILE = f"""profile AS (
  SELECT dag_id, fileloc, CASE WHEN octet_length(data_compressed) > 0 THEN 'Compressed' ELSE 'Uncompressed' END
           AS compression_status,
         {big(SIZE)} AS serialized_size_bytes, {rnd(f"{SIZE} / 1024", 2)} AS serialized_size_kb,
         {rnd(f"{SIZE} / 1048576", 2)} AS serialized_size_mb, {big(STORED)} AS storage_size_bytes,
         {rnd(f"({STORED}) / 1024", 2)} AS storage_size_kb, {rnd(f"({STORED}) / 1048576", 2)} AS storage_size_mb,
         last_updated, {big(AGE)} AS days_since_update, dag_hash, processor_subdir,
         {_occurrences("data", '"task_id"')} AS estimated_task_count, {_first("data", TYPES, "Other")} AS primary_operator_type,
         {_first("data", KINDS, "Standard")} AS complexity_indicators, {big("length(data)")} AS total_length
  FROM serialized_dag WHERE data IS NOT NULL)"""


def _profile(t: Get, **more):
    return documents.document_size_profile(
        t("serialized_dag"), as_of=EVENTS_AS_OF, operator_types=TYPES, complexity=KINDS, **more
    )


@query("d20_document_size_profile", ["serialized_dag"], f"WITH {PROFILE} SELECT * FROM profile")
def _(t: Get):
    return _profile(t)


@query("d20_document_size_profile_top", ["serialized_dag"], f"""WITH {PROFILE}
SELECT * FROM profile ORDER BY total_length DESC, dag_id, fileloc LIMIT 25""")
def _(t: Get):
    return _profile(t, top_n=25)


KB = rnd("serialized_size_bytes / 1024", 2)
STATUS = f"""sized AS (SELECT *, {KB} AS kb FROM profile),
status AS (
  SELECT dag_id, fileloc, serialized_size_bytes, serialized_size_mb, estimated_task_count,
         CASE WHEN serialized_size_mb < 0.05 THEN '<50KB' WHEN serialized_size_mb < 0.5 THEN '50-500KB'
              WHEN serialized_size_mb < 1 THEN '500KB-1MB' WHEN serialized_size_mb < 5 THEN '1-5MB' ELSE '>5MB' END
           AS size_bucket,
         list_filter([CASE WHEN kb > 10 THEN 'CRITICAL_SIZE' END, CASE WHEN kb > 5 AND kb <= 10 THEN 'LARGE_SIZE' END,
                      CASE WHEN kb > 50 THEN 'EXTREMELY_LARGE' END,
                      CASE WHEN kb > 20 AND kb <= 50 THEN 'VERY_LARGE' END,
                      CASE WHEN kb > 10 AND kb <= 20 THEN 'LARGE_SERIALIZATION' END,
                      CASE WHEN kb > 5 AND estimated_task_count < 10 THEN 'LARGE_WITH_FEW_TASKS' END], lambda x: x IS NOT NULL) AS issue_list
  FROM sized),
labelled AS (SELECT * EXCLUDE (issue_list), array_to_string(issue_list, ',') AS issues, issue_list,
                    CASE WHEN list_contains(issue_list, 'CRITICAL_SIZE') THEN 'Critical'
                         WHEN len(issue_list) > 0 THEN 'Warning' ELSE 'Normal' END AS status FROM status)"""


def _status(t: Get):
    return documents.document_size_status(_profile(t), unit_bytes=1024)


@query("d21_document_size_status", ["serialized_dag"], f"WITH {PROFILE}, {STATUS} SELECT * EXCLUDE (issue_list) FROM labelled")
def _(t: Get):
    return _status(t)


@query("d22_document_size_summary", ["serialized_dag"], f"""WITH {PROFILE}, {STATUS}
SELECT COUNT(*) AS total_dags, {rnd("AVG(serialized_size_bytes) / 1048576", 4)} AS avg_size_mb,
       {rnd("MAX(serialized_size_bytes) / 1048576", 4)} AS max_size_mb,
       {rnd("MIN(serialized_size_bytes) / 1024", 2)} AS min_size_kb,
       COUNT(*) FILTER (WHERE len(issue_list) > 0) AS suspicious_dags FROM labelled""")
def _(t: Get):
    return documents.document_size_summary(_status(t))


@query("d22_compression_summary", ["serialized_dag"], f"""WITH {PROFILE}
SELECT compression_status, COUNT(*) AS dags, {rnd("AVG(CAST(serialized_size_kb AS DECIMAL(38,2)))", 2)} AS avg_size_kb,
       MAX(serialized_size_kb) AS max_size_kb FROM profile GROUP BY compression_status""")
def _(t: Get):
    return documents.compression_summary(_profile(t))


@query("d22_largest_documents", ["serialized_dag"], f"""WITH {PROFILE}
SELECT dag_id, fileloc, serialized_size_bytes, serialized_size_mb, storage_size_mb, compression_status,
       estimated_task_count, primary_operator_type
FROM profile ORDER BY serialized_size_bytes DESC, dag_id, fileloc LIMIT 10""")
def _(t: Get):
    return documents.largest_documents(_profile(t))


def _histogram(labels: list[str], case: str) -> str:
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
    return f"""b AS (SELECT {case} AS bucket FROM profile), labels(n, bucket) AS (VALUES {rows})
SELECT {big("l.n")} AS bucket_no, l.bucket, COUNT(b.bucket) AS dags FROM labels l LEFT JOIN b ON l.bucket = b.bucket
GROUP BY l.n, l.bucket"""


@query("d23_size_histogram_mb", ["serialized_dag"], f"WITH {PROFILE}, " + _histogram(
    documents.MB_BUCKETS,
    "CASE WHEN serialized_size_mb < 0.05 THEN '<50KB' WHEN serialized_size_mb < 0.5 THEN '50-500KB' "
    "WHEN serialized_size_mb < 1 THEN '500KB-1MB' WHEN serialized_size_mb < 5 THEN '1-5MB' ELSE '>5MB' END"))
def _(t: Get):
    return documents.size_histogram(_profile(t))


@query("d23_size_histogram_kb", ["serialized_dag"], f"WITH {PROFILE}, " + _histogram(
    documents.KB_BUCKETS,
    "CASE WHEN serialized_size_kb < 50 THEN '<50KB' WHEN serialized_size_kb < 100 THEN '50-100KB' "
    "WHEN serialized_size_kb < 500 THEN '100-500KB' WHEN serialized_size_kb < 1024 THEN '500KB-1MB' ELSE '>1MB' END"))
def _(t: Get):
    return documents.size_histogram(_profile(t), variant="kb")


UPDATED = within("last_updated", EVENTS_AS_OF, EVENTS_DAYS)


@query("d25_serialization_instability", ["serialized_dag"], f"""
SELECT dag_id, COUNT(*) AS update_frequency, MIN(last_updated) AS first_seen, MAX(last_updated) AS last_seen,
       COUNT(DISTINCT dag_hash) AS hash_variations, {rnd(f"AVG({SIZE})")} AS avg_size_bytes,
       {big(f"MAX({SIZE})")} AS max_size_bytes, {big(f"MIN({SIZE})")} AS min_size_bytes
FROM serialized_dag WHERE {UPDATED} GROUP BY dag_id HAVING COUNT(DISTINCT dag_hash) > 3""")
def _(t: Get):
    return documents.serialization_instability(t("serialized_dag"), **EVENT)


@query("d26_frequent_updates", ["serialized_dag"], f"""WITH r AS (
  SELECT dag_id, last_updated, dag_hash,
         ROW_NUMBER() OVER (PARTITION BY dag_id ORDER BY last_updated DESC, dag_hash DESC) AS rn
  FROM serialized_dag WHERE {UPDATED})
SELECT dag_id, COUNT(*) AS update_frequency, MIN(last_updated) AS first_seen, MAX(last_updated) AS last_seen,
       COUNT(DISTINCT dag_hash) AS hash_variations
FROM r WHERE rn <= 20 GROUP BY dag_id HAVING COUNT(DISTINCT dag_hash) > 5""")
def _(t: Get):
    return documents.frequent_updates(t("serialized_dag"), **EVENT, versions=20)


COUNTS = f"""counts AS (
  SELECT dag_id, fileloc, {big("length(data)")} AS size_bytes, {rnd("length(data) / 1024", 2)} AS size_kb,
         {rnd("length(data) / 1048576", 2)} AS size_mb, last_updated, dag_hash,
         {_occurrences("data", "{")} AS open_braces, {_occurrences("data", "}")} AS close_braces,
         {_occurrences("data", "[")} AS open_brackets, {_occurrences("data", "]")} AS close_brackets
  FROM page_documents WHERE data IS NOT NULL),
flagged AS (
  SELECT *, list_filter([CASE WHEN size_mb > 0.005 THEN 'LARGE_SIZE' END,
                         CASE WHEN open_braces <> close_braces THEN 'UNBALANCED_BRACES' END,
                         CASE WHEN open_brackets <> close_brackets THEN 'UNBALANCED_BRACKETS' END,
                         CASE WHEN open_braces > 1 THEN 'DEEP_NESTING' END], lambda x: x IS NOT NULL) AS issue_list
  FROM counts)"""


def _structure(t: Get):
    return documents.structure_counts(t("page_documents"), large_mb=0.005, max_open_braces=1)


@query("d24_document_risk", ["page_documents"], f"""WITH {COUNTS}
SELECT dag_id, fileloc, size_bytes, open_braces,
       CASE WHEN {rnd("size_bytes / 1024", 2)} > 5 THEN 'CRITICAL' WHEN {rnd("size_bytes / 1024", 2)} > 1 THEN 'HIGH'
            WHEN {rnd("size_bytes / 1024", 2)} > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM counts""")
def _(t: Get):
    return documents.document_risk(_structure(t), unit_bytes=1024)


@query("d27_structure_counts", ["page_documents"], f"""WITH {COUNTS}
SELECT * EXCLUDE (issue_list), array_to_string(issue_list, ',') AS issues FROM flagged""")
def _(t: Get):
    return _structure(t)


@query("d28_issue_breakdown", ["page_documents"], f"""WITH {COUNTS}
SELECT issue, COUNT(*) AS dags FROM (SELECT UNNEST(issue_list) AS issue FROM flagged) GROUP BY issue""")
def _(t: Get):
    return documents.issue_breakdown(_structure(t))


@query("d28_suspicious_summary", ["page_documents"], f"""WITH {COUNTS}
SELECT COUNT(*) AS total_analyzed, COUNT(*) FILTER (WHERE len(issue_list) > 0) AS total_suspicious,
       {rnd("AVG(size_mb) FILTER (WHERE len(issue_list) > 0)", 4)} AS avg_suspicious_mb,
       MAX(size_mb) FILTER (WHERE len(issue_list) > 0) AS max_suspicious_mb FROM flagged""")
def _(t: Get):
    return documents.suspicious_summary(_structure(t))


@query("d30_json_valid", ["json_documents"], "SELECT dag_id, json_valid(data) AS json_valid FROM json_documents")
def _(t: Get):
    return documents.json_validity(t("json_documents")).select("dag_id", "json_valid")


OUTLINE = r"""regexp_replace(regexp_replace(regexp_replace(data, '(?s)\\.', '', 'g'), '"[^"]*"', 's', 'g'), '\s+', '', 'g')"""
BRACKETS = rf"""translate(regexp_replace(regexp_replace({OUTLINE}, '\{{\}}|\[\]', '0', 'g'), '[^\[\]{{}}]', '', 'g'), '[]', '{{}}')"""


@query("d31_json_depth", ["json_documents"], f"""WITH v AS (SELECT dag_id, data FROM json_documents WHERE json_valid(data)),
b AS (SELECT dag_id, {BRACKETS} AS b FROM v),
p AS (SELECT dag_id, b, UNNEST(range(0, length(b) + 1)) AS i FROM b)
SELECT dag_id, {big("MAX(2 * length(replace(substr(b, 1, i), '}', '')) - i)")} AS json_depth FROM p GROUP BY dag_id""")
def _(t: Get):
    checked = documents.content_checks(t("json_documents"), max_depth=2)
    return checked.where("json_valid").select("dag_id", "json_depth")


@query("d31_json_depth_nested", ["json_nested"], f"""WITH b AS (SELECT event_id, {BRACKETS.replace("data", "props")} AS b FROM events),
p AS (SELECT event_id, b, UNNEST(range(0, length(b) + 1)) AS i FROM b),
inner_depth AS (SELECT event_id, MAX(2 * length(replace(substr(b, 1, i), '}}', '')) - i) AS d FROM p GROUP BY event_id)
SELECT event_id, json_valid(data) AS json_valid, {big("event_id % 1700 + 1 + d")} AS json_depth,
       event_id % 1700 + 1 + d > 1000 AS is_deep FROM json_nested JOIN inner_depth USING (event_id)""")
def _(t: Get):
    checked = documents.content_checks(t("json_nested"), max_depth=1000, only=["json_depth"])
    return checked.select("event_id", "json_valid", "json_depth", F.array_contains("issues", "DEEP_NESTING").alias("is_deep"))


MARKED = dict(max_references=2, max_tasks=3, max_depth=4, large_string_chars=40, max_repeats=5)
MEASURES = f"""v AS (SELECT dag_id, data, least(1000, length(data) // 10) AS n FROM json_marked),
b AS (SELECT dag_id, {BRACKETS} AS b FROM v),
p AS (SELECT dag_id, b, UNNEST(range(0, length(b) + 1)) AS i FROM b),
deep AS (SELECT dag_id, MAX(2 * length(replace(substr(b, 1, i), '}}', '')) - i) AS json_depth FROM p GROUP BY dag_id),
m AS (SELECT dag_id, {_occurrences("data", '"_dag"')} AS dag_references, {_occurrences("data", '"task_id"')} AS task_references,
    contains(data, '"pickle"') OR contains(data, '"__reduce__"') AS has_pickle, json_depth,
    len(regexp_extract_all(data, '"[^"]{{40,}}"')) AS large_strings,
    CASE WHEN n >= 100 THEN (length(data) - length(replace(data, substr(data, 1, n), ''))) / n END AS prefix_repeats
    FROM v JOIN deep USING (dag_id))"""


@query("d32_repeated_references", ["json_marked"], f"""WITH {MEASURES}
SELECT dag_id, {big("dag_references")} AS dag_references, {big("task_references")} AS task_references,
       dag_references > 2 AS is_circular, task_references > 3 AS is_excessive FROM m""")
def _(t: Get):
    checked = documents.content_checks(t("json_marked"), **MARKED)
    return checked.select(
        "dag_id",
        "dag_references",
        "task_references",
        F.array_contains("issues", "POTENTIAL_CIRCULAR_REFS").alias("is_circular"),
        F.array_contains("issues", "EXCESSIVE_TASKS").alias("is_excessive"),
    )


@query("d33_pickle_markers", ["json_marked"], f"""WITH {MEASURES}
SELECT dag_id, has_pickle, has_pickle AS is_flagged FROM m""")
def _(t: Get):
    checked = documents.content_checks(t("json_marked"), **MARKED)
    return checked.select("dag_id", "has_pickle", F.array_contains("issues", "PICKLE_DETECTED").alias("is_flagged"))


@query("d34_large_strings", ["json_documents"], f"""
SELECT dag_id, {big("len(regexp_extract_all(data, '" + '"[^"]{300,}"' + "'))")} AS large_strings
FROM json_documents WHERE json_valid(data)""")
def _(t: Get):
    checked = documents.content_checks(t("json_documents"), large_string_chars=300)
    return checked.where("json_valid").select("dag_id", "large_strings")


@query("d35_repetitive_prefix", ["serialized_dag"], f"""WITH s AS (
  SELECT fileloc, data, least(1000, length(data) // 10) AS n FROM serialized_dag)
SELECT fileloc, CASE WHEN n >= 100 THEN {big("(length(data) - length(replace(data, substr(data, 1, n), ''))) / n")} END
  AS prefix_repeats FROM s""")
def _(t: Get):
    return t("serialized_dag").select("fileloc", documents.prefix_repeats("data").alias("prefix_repeats"))


@query("d36_content_issues", ["json_marked"], f"""WITH {MEASURES},
named AS (SELECT dag_id, UNNEST([CASE WHEN dag_references > 2 THEN 'POTENTIAL_CIRCULAR_REFS' END,
    CASE WHEN has_pickle THEN 'PICKLE_DETECTED' END, CASE WHEN task_references > 3 THEN 'EXCESSIVE_TASKS' END,
    CASE WHEN json_depth > 4 THEN 'DEEP_NESTING' END, CASE WHEN large_strings > 0 THEN 'LARGE_STRINGS' END,
    CASE WHEN prefix_repeats > 5 THEN 'REPETITIVE_PATTERNS' END]) AS issue FROM m)
SELECT issue, COUNT(*) AS dags FROM named WHERE issue IS NOT NULL GROUP BY issue ORDER BY issue""")
def _(t: Get):
    return documents.issue_breakdown(documents.content_checks(t("json_marked"), **MARKED))


UNITS = "CASE " + " ".join(
    f"WHEN s >= {f} THEN CAST(CAST(floor((floor(s / {h}) + 1) / 2) AS BIGINT) AS VARCHAR) || ' {u}'"
    for f, h, u in [(20479 * 512 * 1024, 512 * 1024**2, "GB"), (20479 * 512, 512 * 1024, "MB"), (10240, 512, "kB")]
) + " ELSE CAST(s AS VARCHAR) || ' bytes' END"


@query("f11_pretty_size", [], f"""SELECT o_orderkey, {UNITS} AS pretty
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 97 AS s FROM orders)""")
def _(t: Get):
    size = F.col("o_orderkey") * F.col("o_orderkey") * 97
    return t("orders").select("o_orderkey", pretty_size(size).alias("pretty"))


@query("f15_shorten", ["serialized_dag"], """
SELECT fileloc, CASE WHEN length(data) > 37 THEN substr(data, 1, 34) || '...' ELSE data END AS head,
       CASE WHEN length(fileloc) > 12 THEN '...' || right(fileloc, 9) ELSE fileloc END AS tail FROM serialized_dag""")
def _(t: Get):
    return t("serialized_dag").select(
        "fileloc", shorten_end("data", 37).alias("head"), shorten_start("fileloc", 12).alias("tail")
    )


@query("f17_connection_parts", [], f"""
SELECT c_custkey, c_name AS username, 'h' || c_nationkey AS host,
       {big("CASE WHEN c_custkey % 2 = 0 THEN 6000 + c_nationkey ELSE 5432 END")} AS port,
       CASE WHEN c_custkey % 3 = 0 THEN 'airflow' ELSE lower(c_mktsegment) END AS database FROM customer""")
def _(t: Get):
    url = F.concat(
        F.lit("postgresql+psycopg2://"), F.col("c_name"), F.lit(":pw@h"), F.col("c_nationkey"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(":"), F.col("c_nationkey") + 6000)).otherwise(""),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("/"), F.lower("c_mktsegment"))),
        F.lit("?sslmode=require"),
    )
    return t("customer").select("c_custkey", connection_parts(url).alias("p")).select("c_custkey", "p.*")
