"""Appends that may be repeated, changes by bucket, and split points."""

from __future__ import annotations

import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runscope.operators import identity, rbac
from runscope.sources import stored


def batch(spark, first, n):
    return spark.range(first, first + n).selectExpr("id", "concat('v', id) AS value")


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored.append_batch(batch(spark, 0, 10), path, "one") and stored.append_batch(batch(spark, 10, 5), path, "two")
    assert not stored.append_batch(batch(spark, 0, 10), path, "one")
    table = stored.read_batches(spark, path)
    assert Counter(r.batch_id for r in table.collect()) == {"one": 10, "two": 5}
    assert sorted(r.id for r in table.collect()) == list(range(15))
    assert {(r.batch_id, r.rows) for r in stored.committed_batches(spark, path).collect()} == {("one", 10), ("two", 5)}


def test_a_failed_batch_is_not_seen_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.append_batch(batch(spark, 0, 3), path, "one")
    broken = spark.range(100).repartition(8).selectExpr("IF(id = 77, raise_error('broken'), id) AS id", "'x' AS value")
    with pytest.raises(Exception, match="broken"):
        stored.append_batch(broken, path, "two")
    # a run that wrote its files and ended before the ledger knew
    batch(spark, 500, 4).write.parquet(f"{path}/batch_id=three")
    assert stored.read_batches(spark, path).count() == 3
    assert stored.append_batch(batch(spark, 10, 2), path, "two") and stored.append_batch(batch(spark, 500, 2), path, "three")
    assert sorted(r.id for r in stored.read_batches(spark, path).collect()) == [0, 1, 2, 10, 11, 500, 501]


def test_rows_left_to_append(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "id int, v string")
    left = stored.missing_rows(rows, rows.where("id = 1"), ["id"])
    assert sorted(r.id for r in left.collect()) == [2, 3]
    assert stored.missing_rows(rows, rows, ["id"]).count() == 0


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_changes_rewrite_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.write_buckets(batch(spark, 0, 2000), path, "id", 32)
    before = files(path)
    rows = spark.createDataFrame([(5, "new"), (9999, "added")], "id bigint, value string")
    gone = spark.createDataFrame([(7,), (123456,)], "id bigint")
    touched = stored.apply_changes(spark, path, "id", rows, gone, 32)
    after = files(path)
    assert 0 < len(touched) <= 4
    for f in before:
        assert (f in after and after[f] == before[f]) != any(f"/bucket={n}/" in f for n in touched)
    wanted = {**{i: f"v{i}" for i in range(2000) if i != 7}, 5: "new", 9999: "added"}
    held = lambda: {r.id: r.value for r in stored.read_buckets(spark, path).collect()}
    assert held() == wanted and stored.read_buckets(spark, path).count() == len(wanted)
    assert stored.apply_changes(spark, path, "id", rows, gone, 32) == touched and held() == wanted
    assert stored.apply_changes(spark, path, "id", rows.limit(0), None, 32) == []


def test_a_bucket_may_become_empty_and_keys_may_be_null(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(None, "n"), (1, "a"), (1, "b"), (2, "c"), (3, "d")]
    stored.write_buckets(spark.createDataFrame(rows, "id bigint, v string"), path, "id", 16)
    stored.apply_changes(spark, path, "id", spark.createDataFrame([], "id bigint, v string"), spark.createDataFrame([(1,), (None,)], "id bigint"), 16)
    assert sorted((r.id, r.v) for r in stored.read_buckets(spark, path).collect()) == [(2, "c"), (3, "d")]
    assert len(glob.glob(f"{path}/bucket=*")) <= 2


def test_users_and_links_by_bucket(spark, tmp_path, make):
    """An upsert, a role change, a patch and a deletion on stored tables give the tables that the operators describe."""
    users = make("ab_user", [
        {"id": i, "username": f"u{i}", "first_name": "f", "last_name": "l", "email": f"u{i}@example.com", "active": True}
        for i in range(1, 200)
    ])
    roles = make("ab_role", [{"id": 1, "name": "User"}, {"id": 2, "name": "Op"}])
    links = spark.createDataFrame([(i, 1) for i in range(1, 200)], "user_id int, role_id int")
    up, lp = str(tmp_path / "users"), str(tmp_path / "links")
    stored.write_buckets(users, up, "id", 16)
    stored.write_buckets(links, lp, "user_id", 16)

    def tables():
        return {"ab_user": stored.read_buckets(spark, up), "ab_role": roles, "ab_user_role": stored.read_buckets(spark, lp)}

    def rows(df):
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    asked = spark.createDataFrame([("u5", "new@example.com", None, None), ("zoe", None, None, None)], "username string, email string, first_name string, last_name string")
    changes = rbac.upsert_users(tables(), asked, as_of="2024-01-01")
    wanted = rows(rbac.users_after({"ab_user": users}, changes))
    stored.apply_changes(spark, up, "id", changes.updates.unionByName(changes.inserts), None, 16)
    assert rows(stored.read_buckets(spark, up)) == wanted

    targets = spark.createDataFrame([("u5", "Op"), ("zoe", "User"), ("nobody", "Op")], "username string, role_name string")
    granted = rbac.granted_roles(tables(), targets)
    wanted = rows(rbac.replace_user_role({**tables(), "ab_user_role": links}, targets).user_roles)
    stored.apply_changes(spark, lp, "user_id", granted.links, None, 16)
    assert rows(stored.read_buckets(spark, lp)) == wanted

    gone = identity.delete_users(users, links, spark.createDataFrame([("u7",), ("u9",)], "username string"))
    ids, _ = identity.lookup_users(tables()["ab_user"], spark.createDataFrame([("u7",), ("u9",)], "username string"))
    empty = stored.read_buckets(spark, up).limit(0)
    ids = ids.select("id").checkpoint()
    stored.apply_changes(spark, up, "id", empty, ids, 16)
    stored.apply_changes(spark, lp, "user_id", links.limit(0), ids.select(F.col("id").alias("user_id")), 16)
    names = {r.username for r in stored.read_buckets(spark, up).collect()}
    assert names == {r.username for r in gone.users.collect()} | {"zoe"}
    assert not {7, 9} & {r.user_id for r in stored.read_buckets(spark, lp).collect()}


@pytest.mark.parametrize("parts", [1, 4, 16, 64])
def test_split_points_of_skewed_ids(spark, parts):
    """Ids that grow in bursts: equal steps would put nearly all into one range."""
    rng = random.Random(2)
    ids = sorted({int(rng.paretovariate(0.3)) % 10**12 for _ in range(20_000)})
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)] * 7, "id bigint")
    bounds = stored.equi_depth_bounds(df, "id", parts)
    predicates = stored.range_predicates("id", bounds)
    sizes = [df.where(p).count() for p in predicates]
    assert sum(sizes) == len(ids) + 7 and len(sizes) <= parts
    if parts > 1:
        assert len(sizes) == parts and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_split_points_of_odd_columns(spark):
    same = spark.createDataFrame([(5,)] * 10, "id int")
    assert stored.equi_depth_bounds(same, "id", 8) == [] and stored.range_predicates("id", []) == ["1 = 1"]
    assert stored.equi_depth_bounds(same.limit(0), "id", 8) == []
    assert stored.range_predicates("n", ["o'k"]) == ["(n < 'o''k' OR n IS NULL)", "n >= 'o''k'"]


def test_bounds_query_on_a_database():
    """The text that a database is asked, here by an engine in this process."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT CAST(pow(i, 3) AS BIGINT) AS id FROM range(50000) r(i)")
    bounds = [r[0] for r in con.execute(stored.bounds_query("t", "id", 8, 50_000)).fetchall()][1:]
    sizes = [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in stored.range_predicates("id", bounds)]
    assert sum(sizes) == 50_000 and len(sizes) == 8 and max(sizes) <= 2 * 50_000 / 8
