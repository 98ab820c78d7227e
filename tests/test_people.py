"""Roles, users and username cleaning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runscope.operators import identity, rbac
from runscope.streaming import users as user_stream

from .conftest import as_dicts

NOW = "2024-01-08 00:00:00"


@pytest.fixture()
def tables(make):
    """Views: DAGs, DAG:a, DAG:b, DAGsOther, Home; permissions: can_read, menu_access."""
    menus = ["DAGs", "DAG:a", "DAG:b", "DAGsOther", "Home"]
    views = [{"id": 10 * m + p, "permission_id": p, "view_menu_id": m} for m in range(1, 6) for p in (1, 2)]
    return {
        "ab_role": make("ab_role", [{"id": 1, "name": "Admin"}, {"id": 3, "name": "User"}]),
        "ab_permission": make("ab_permission", [{"id": 1, "name": "can_read"}, {"id": 2, "name": "menu_access"}]),
        "ab_view_menu": make("ab_view_menu", [{"id": i, "name": n} for i, n in enumerate(menus, start=1)]),
        "ab_permission_view": make("ab_permission_view", views),
        "ab_permission_view_role": make("ab_permission_view_role", [{"permission_view_id": v["id"], "role_id": 3} for v in views] * 2),
        "ab_user": make("ab_user", [
            {"id": 1, "username": "x/ann", "email": "ann@x", "first_name": "Ann", "active": True},
            {"id": 5, "username": "bob", "email": "bob@x", "first_name": "Bob", "active": True},
        ]),
        "ab_user_role": make("ab_user_role", [{"user_id": 1, "role_id": 1}, {"user_id": 1, "role_id": 3}, {"user_id": 5, "role_id": 1}]),
    }


def ids(df, column="permission_view_id"):
    return sorted(r[column] for r in df.collect())


def test_base_and_dag_permissions(tables):
    assert ids(rbac.role_permissions_base(tables, "User")) == [51, 52]
    assert ids(rbac.role_permissions_base(tables, "Nobody")) == []
    assert ids(rbac.dag_permissions(tables, ["a", "missing"])) == [21, 22]
    assert ids(rbac.menu_permission(tables)) == [12]


def test_derive_role(tables):
    new = rbac.derive_role(tables, "User", "MyRole", ["a"])
    assert as_dicts(new.roles) == [{"id": 4, "name": "MyRole"}]
    assert ids(new.permissions) == [12, 21, 22, 51, 52]
    assert ids(rbac.derive_role(tables, "User", "MyRole").permissions) == [12, 51, 52]
    assert ids(rbac.derive_role(tables, "User", "MyRole", menu_mode="with_dags").permissions) == [51, 52]
    assert ids(rbac.derive_role(tables, "User", "MyRole", ["b"], menu_mode="with_dags").permissions) == [12, 31, 32, 51, 52]


def test_derive_existing_or_unknown(tables):
    with pytest.raises(ValueError):
        rbac.derive_role(tables, "User", "Admin")
    skipped = rbac.derive_role(tables, "User", "Admin", on_existing="skip")
    assert skipped.roles.count() == 0 and skipped.permissions.count() == 0
    assert rbac.derive_role(tables, "Nobody", "New").roles.count() == 0
    empty = {**tables, "ab_role": tables["ab_role"].where("name = 'User'").withColumn("id", F.lit(0))}
    assert rbac.derive_role(empty, "User", "New").roles.first()["id"] == 1


def test_many_roles_get_different_ids(spark, tables):
    requests = spark.createDataFrame([(f"r{i}", "User", ["a"]) for i in range(50)] + [("r1", "User", None)], "role_name string, source_role string, specific_dags array<string>")
    new = rbac.derive_roles(tables, requests)
    assert ids(new.roles, "id") == list(range(4, 54))
    assert new.permissions.count() >= 50 * 3


def test_user_roles_and_existence(spark, tables):
    assert sorted(tuple(r) for r in rbac.user_roles(tables, ["x/ann"]).collect()) == [("x/ann", "Admin"), ("x/ann", "User")]
    assert [r["name"] for r in rbac.list_roles(tables).collect()] == ["Admin", "User"]
    names = spark.createDataFrame([("bob",), ("eve",)], "name string")
    assert {r["name"]: (r["id"], r["found"]) for r in rbac.existence(tables, names, kind="user").collect()} == {"bob": (5, True), "eve": (None, False)}


def requests(spark, rows):
    return spark.createDataFrame(rows, "username string, email string, first_name string, last_name string")


def test_upsert(spark, tables):
    asked = requests(spark, [("a/new", None, None, ""), ("a/new", None, None, "Last"), ("bob", "b@new", "", None), ("x/ann", None, None, None)])
    changes = rbac.upsert_users(tables, asked, as_of=NOW)
    new = changes.inserts.first()
    assert (new["id"], new["first_name"], new["last_name"], new["email"], new["active"]) == (6, "a/new", "Last", "a_new@example.com", True)
    assert [(r["username"], r["email"], r["first_name"]) for r in changes.updates.collect()] == [("bob", "b@new", "Bob")]
    after = {r["username"]: r["email"] for r in rbac.users_after(tables, changes).collect()}
    assert after == {"x/ann": "ann@x", "bob": "b@new", "a/new": "a_new@example.com"}
    assert rbac.upsert_users(tables, asked, as_of=NOW, safe_email=False).inserts.first()["email"] == "a/new@example.com"
    assert rbac.upsert_users(tables, asked, as_of=NOW, update_existing=False).updates.count() == 0


def test_replace_role(spark, tables):
    targets = spark.createDataFrame([("x/ann", "User"), ("bob", "Nobody"), ("eve", "User")], "username string, role_name string")
    change = rbac.replace_user_role(tables, targets)
    assert sorted(tuple(r) for r in change.user_roles.collect()) == [(1, 3), (5, 1)]
    assert sorted(r["username"] for r in change.rejected.collect()) == ["bob", "eve"]


GROUP_MAP = [
    {"precedence": 1, "idp_group": "g0", "iam_role": "i0", "app_role": "Admin"},
    {"precedence": 2, "idp_group": "g1", "iam_role": "i1", "app_role": "Custom", "specific_dags": ["a"]},
]


def test_group_mapping(make):
    logins = make("logins", [{"user_id": 1, "groups": "[g1, g0]"}, {"user_id": 2, "groups": "g1"}, {"user_id": 3, "groups": "[other]"}, {"user_id": 4}])
    assigned = rbac.group_to_role(logins, make("group_map", GROUP_MAP), account_id="42")
    got = {r["user_id"]: (r["app_role"], r["role_arn"], r["specific_dags"]) for r in assigned.collect()}
    assert got == {1: ("Admin", "arn:aws:iam::42:role/i0", None), 2: ("Custom", "arn:aws:iam::42:role/i1", ["a"]), 3: ("Public", "", None), 4: ("Public", "", None)}
    custom = {r["user_id"]: r["needs_custom_role"] for r in rbac.needs_custom_role(assigned).collect()}
    assert custom == {1: False, 2: True, 3: True, 4: True}


def test_provisioning(make, tables):
    logins = make("logins", [{"user_id": 1, "username": "x/ann", "groups": "g1"}, {"user_id": 9, "username": "n/new", "groups": "[g1]"}, {"user_id": 5, "username": "bob", "groups": "g0"}])
    after = rbac.provision_batch(tables, logins, make("group_map", GROUP_MAP), as_of=NOW)
    role = after.ab_role.where("name = 'Custom'").first()["id"]
    assert role == 4 and ids(after.ab_permission_view_role.where(F.col("role_id") == role)) == [12, 21, 22, 51, 52]
    assert {r["username"]: r["first_name"] for r in after.ab_user.collect()} == {"x/ann": "x/ann", "bob": "Bob", "n/new": "n/new"}
    assert sorted(tuple(r) for r in after.ab_user_role.collect()) == [(1, 4), (5, 1), (6, 4)]
    assert after.rejected.count() == 0


def names(spark, expression, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", expression("x").alias("y")).orderBy("i").collect()]


def test_username_rules(spark):
    assert names(spark, identity.sanitize_username, "test/user_1", "plain", "a/b/c", None) == ["test_user_1", "plain", "a_b_c", None]
    assert names(spark, identity.sanitize_special, 'a/\\ :*?"<>|b') == ["a" + "_" * 10 + "b"]
    assert names(spark, identity.sanitize_lower, "DOM/User") == ["dom_user"]
    assert names(spark, identity.sanitize_short, "a/" + "b" * 60) == ["a_" + "b" * 48]
    assert names(spark, identity.domain_to_suffix, "DOM/user", "a/b/c", "plain") == ["user@DOM", "b/c@a", "plain"]
    assert names(spark, identity.sanitize_whitelist, "a b/é.c-d_1") == ["a_b__.c-d_1"]
    mail = lambda x: identity.username_from_email(x, F.concat(F.lit("first.last@"), F.col(x)))
    assert names(spark, mail, "d/u", "u") == ["first_last", "u"]
    assert names(spark, lambda x: identity.username_from_email(x, F.lit("no address")), "d/u") == ["d_u"]
    assert names(spark, lambda x: identity.sanitize_by_role(x, F.array(F.lit("Admin"))), "d/u") == ["d@u"]
    assert names(spark, lambda x: identity.sanitize_by_role(x, F.lit(None).cast("array<string>")), "d/u") == ["d_u"]
    assert names(spark, lambda x: identity.keep_original(x, F.lit("")), "d/u", "u") == ["Original: d/u", ""]
    assert names(spark, lambda x: identity.keep_original(x, F.lit("Ann")), "d/u") == ["Ann"]


def test_logs_and_collisions(spark, tables):
    valid, rejected = identity.split_valid(tables["ab_user"])
    assert ids(valid, "id") == [5] and ids(rejected, "id") == [1]
    users = tables["ab_user"].withColumn("created_by", F.lit(None).cast("string"))
    log = {r["username"]: (r["roles"], r["created_by"]) for r in identity.audit_log(users, rbac.user_roles(tables), as_of=NOW).collect()}
    assert log == {"x/ann": (["Admin", "User"], "system"), "bob": (["Admin"], "system")}
    same = spark.createDataFrame([("a/b",), ("a_b",), ("c",)], "username string")
    assert as_dicts(identity.collisions(same, identity.sanitize_username("username"))) == [{"username": "a_b", "users": 2, "first_original": "a/b"}]
    assert as_dicts(identity.rename_log(same)) == [{"original_username": "a/b", "username": "a_b"}]


PATCH = "request_id int, username string, new_username string, new_email string, new_first_name string, new_last_name string, new_active boolean, new_roles array<string>, update_mask string"


def patch(spark, tables, *rows):
    fields = ["new_username", "new_email", "new_first_name", "new_last_name", "new_active", "new_roles", "update_mask"]
    data = [(i, r["username"], *[r.get(f) for f in fields]) for i, r in enumerate(rows)]
    done = identity.patch_users(tables["ab_user"], tables["ab_role"], spark.createDataFrame(data, PATCH))
    refused = {r["request_id"]: (r["code"], r["detail"]) for r in done.rejected.collect()}
    return {r["id"]: r.asDict() for r in done.users.collect()}, sorted(tuple(r) for r in done.user_roles.collect()), refused


def test_patch_applies(spark, tables):
    users, links, refused = patch(spark, tables, {"username": "x/ann", "new_email": "n@x", "new_active": False, "new_roles": ["User", "User"]})
    assert refused == {} and links == [(1, 3)]
    assert (users[1]["email"], users[1]["active"], users[1]["first_name"]) == ("n@x", False, "Ann")
    users, links, refused = patch(spark, tables, {"username": "bob", "new_email": "n@x", "new_roles": ["Admin"], "update_mask": " roles "})
    assert users[5]["email"] == "bob@x" and links == [(5, 1)] and refused == {}


def test_patch_refuses(spark, tables):
    _, _, refused = patch(
        spark,
        tables,
        {"username": "eve", "new_email": "bob@x"},
        {"username": "x/ann", "new_username": "bob"},
        {"username": "bob", "new_email": "ann@x", "update_mask": "first_name"},
        {"username": "bob", "update_mask": "email"},
    )
    assert refused == {0: (404, "no user eve"), 1: (409, "username taken: bob"), 2: (409, "email taken: ann@x"), 3: (409, "already patched: bob")}
    assert patch(spark, tables, {"username": "bob", "new_first_name": "B", "update_mask": "first_name, email"})[2] == {0: (400, "not sent: email")}
    assert patch(spark, tables, {"username": "bob", "new_roles": ["User", "Zed", "Abc"]})[2] == {0: (400, "unknown roles: Abc, Zed")}
    both = patch(spark, tables, {"username": "bob", "new_email": "same@x"}, {"username": "x/ann", "new_email": "same@x"})
    assert set(both[0]) == {5} and both[2] == {1: (409, "email taken: same@x")}
    assert patch(spark, tables, {"username": "bob", "new_username": "bob", "new_email": "bob@x"})[2] == {}


def test_lookup_and_delete(spark, tables):
    wanted = spark.createDataFrame([("x/ann",), ("x_ann",)], "username string")
    found, missing = identity.lookup_users(tables["ab_user"], wanted)
    assert ids(found, "id") == [1] and ids(missing, "username") == ["x_ann"]
    left = identity.delete_users(tables["ab_user"], tables["ab_user_role"], wanted)
    assert ids(left.users, "id") == [5] and ids(left.user_roles, "user_id") == [5] and ids(left.not_found, "username") == ["x_ann"]


def test_cleaning_runs_on_a_stream(spark, tables, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    tables["ab_user"].write.parquet(source)
    stream = spark.readStream.schema(tables["ab_user"].schema).parquet(source)
    query = user_stream.write_cleaned_users(stream, target, str(tmp_path / "checkpoint"))
    query.awaitTermination(60)
    got = {r["original_username"]: (r["username"], r["username_changed"]) for r in spark.read.parquet(target).collect()}
    assert got == {"x/ann": ("x_ann", True), "bob": ("bob", False)}


REQUEST = "role_name string, source_role string, specific_dags array<string>"


def test_requests_for_one_role_are_settled_by_a_stated_order(spark, tables):
    requests = [("New", "User", ["b"]), ("New", "Nobody", ["a"]), ("New", "User", ["a"]), ("Admin", "User", None), ("Lost", None, None)]
    for order in (requests, requests[::-1]):
        new = rbac.derive_roles(tables, spark.createDataFrame(order, REQUEST).repartition(3))
        assert sorted(tuple(r) for r in new.rejected.collect()) == [
            ("Admin", "User", "role exists"), ("Lost", None, "unknown source role"), ("New", "Nobody", "unknown source role"),
        ]
        assert new.roles.count() == 0 and new.permissions.count() == 0


def test_unknown_source_can_still_make_a_role(spark, tables):
    requests = spark.createDataFrame([("New", "Nobody", ["a"]), ("Bare", "Nobody", None)], REQUEST)
    new = rbac.derive_roles(tables, requests, unknown_source="create", menu_mode="with_dags")
    role = {r["name"]: r["id"] for r in new.roles.collect()}
    assert ids(new.permissions.where(f"role_id = {role['New']}")) == [12, 21, 22]
    assert ids(new.permissions.where(f"role_id = {role['Bare']}")) == []
    with pytest.raises(ValueError):
        rbac.derive_roles(tables, requests, unknown_source="guess")


def test_two_mappings_to_one_role(spark, make, tables):
    """The list of the mapping with the lowest precedence counts, whoever logs in first in the table."""
    mapping = [
        {"precedence": 7, "idp_group": "late", "iam_role": "r", "app_role": "Shared", "specific_dags": ["b"]},
        {"precedence": 2, "idp_group": "early", "iam_role": "r", "app_role": "Shared", "specific_dags": ["a"]},
    ]
    logins = [{"user_id": 1, "username": "u1", "groups": "[late]"}, {"user_id": 2, "username": "u2", "groups": "early"}]
    after = rbac.provision_batch(tables, make("logins", logins), make("group_map", mapping), as_of="2024-01-01")
    role = after.ab_role.where("name = 'Shared'").first()["id"]
    assert ids(after.ab_permission_view_role.where(f"role_id = {role}")) == [12, 21, 22, 51, 52]
    assert after.rejected.count() == 0
    refused = rbac.provision_batch(
        tables, make("logins", logins), make("group_map", mapping), as_of="2024-01-01", source_role="Nobody"
    )
    assert sorted(r["username"] for r in refused.rejected.collect()) == ["u1", "u2"]
