"""The same changes on stored tables: batches appended twice, and changes that rewrite the buckets they meet.

Each writes its tables below the checkpoint folder; the twins are those of the queries that give the changed tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.operators import identity, rbac
from runscope.sources import stored

from . import q_people
from .q_states import from_states
from .register import EVENTS_AS_OF, Get, checkpoint_folder, query

BUCKETS = 16


def _stored(df: DataFrame, key: str) -> str:
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    stored.write_buckets(df, path, key, BUCKETS)
    return path


@query("k08_append_batches", ["task_fail"], """
SELECT CASE WHEN try = 0 THEN 'even' ELSE 'odd' END AS batch_id, dag_id, task_id, COUNT(*) AS rows
FROM (SELECT dag_id, task_id, CAST(EXTRACT(minute FROM start_date) AS INT) % 2 AS try FROM task_fail) GROUP BY ALL""")
def _(t: Get):
    """Two batches, each appended twice: the second time adds nothing."""
    rows = t("task_fail")
    path = f"{checkpoint_folder(rows.sparkSession)}/batches-{uuid.uuid4()}"
    for _ in range(2):
        for name, half in (("even", 0), ("odd", 1)):
            stored.append_batch(rows.where(F.minute("start_date") % 2 == half), path, name)
    return stored.read_batches(rows.sparkSession, path).groupBy("batch_id", "dag_id", "task_id").agg(F.count(F.lit(1)).alias("rows"))


@from_states("r08_upsert_users_by_bucket", "r08_upsert_users")
def _(t: Get):
    tables = q_people._tables(t)
    users = tables["ab_user"]
    path = _stored(users, "id")
    changes = rbac.upsert_users(tables, q_people._asked(t), as_of=EVENTS_AS_OF)
    stored.apply_changes(users.sparkSession, path, "id", changes.updates.unionByName(changes.inserts.select(*users.columns)), None, BUCKETS)
    return stored.read_buckets(users.sparkSession, path).select("username", "first_name", "last_name", "email", "active")


@from_states("r09_replace_user_role_by_bucket", "r09_replace_user_role")
def _(t: Get):
    tables = q_people._tables(t)
    links = tables["ab_user_role"].select("user_id", "role_id").distinct()
    path = _stored(links, "user_id")
    granted = rbac.granted_roles(tables, q_people._targets(t)).links
    stored.apply_changes(links.sparkSession, path, "user_id", granted, None, BUCKETS)
    return stored.read_buckets(links.sparkSession, path)


@query("u13_patch_users_by_bucket", ["ab_user"], f"""WITH {q_people.PATCHES}, {q_people.REFUSED},
done AS (SELECT p.* FROM patches p JOIN refused r USING (request_id) WHERE r.code IS NULL)
SELECT CAST(u.id AS BIGINT) AS id, CASE WHEN p.kind = 0 THEN p.new_username ELSE u.username END AS username,
       CASE WHEN p.kind = 2 THEN p.new_email ELSE u.email END AS email
FROM ab_user u LEFT JOIN done p ON p.id = u.id""")
def _(t: Get):
    users = t("ab_user")
    path = _stored(users, "id")
    patched = identity.patch_users(users, t("ab_role"), q_people._patches(t)).users
    stored.apply_changes(users.sparkSession, path, "id", patched, None, BUCKETS)
    return stored.read_buckets(users.sparkSession, path).select("id", "username", "email")


@from_states("u14_delete_users_by_bucket", "u14_delete_users")
def _(t: Get):
    users = t("ab_user")
    path = _stored(users, "id")
    gone, _ = identity.lookup_users(users, q_people._wanted(t))
    stored.apply_changes(users.sparkSession, path, "id", users.limit(0), gone.select("id"), BUCKETS)
    return stored.read_buckets(users.sparkSession, path).select("id", "username")
