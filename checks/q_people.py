"""Role and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runscope.operators import identity, rbac

from .bindings import RBAC
from .register import EVENTS_AS_OF, Get, big, checkpoint_folder, query

NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"


def _tables(t: Get):
    return {n: t(n) for n in RBAC}


# which pages and views count is said by sets of ids
BASE = """workflow_views AS (SELECT id FROM ab_permission_view
  WHERE view_menu_id IN (SELECT id FROM ab_view_menu WHERE regexp_matches(name, '^DAG(s|:)'))),
base AS (SELECT DISTINCT permission_view_id, (SELECT name FROM ab_role WHERE id = role_id) AS role_name
  FROM ab_permission_view_role
  WHERE permission_view_id IN (SELECT id FROM ab_permission_view) AND permission_view_id NOT IN (SELECT id FROM workflow_views))"""
MENU = """menu AS (SELECT id AS permission_view_id FROM ab_permission_view
  WHERE view_menu_id IN (SELECT id FROM ab_view_menu WHERE name = 'DAGs')
  AND permission_id IN (SELECT id FROM ab_permission WHERE name = 'menu_access'))"""


def _dag_views(*names: str) -> str:
    listed = ", ".join(f"'DAG:{n}'" for n in names)
    return f"""dag_views AS (SELECT id AS permission_view_id FROM ab_permission_view
  WHERE view_menu_id IN (SELECT id FROM ab_view_menu WHERE name IN ({listed})))"""


PERMISSION_TABLES = ["ab_role", "ab_permission", "ab_view_menu", "ab_permission_view", "ab_permission_view_role"]


@query("r01_role_permissions_base", PERMISSION_TABLES,
       f"WITH {BASE} SELECT {big('permission_view_id')} AS permission_view_id FROM base WHERE role_name = 'User'")
def _(t: Get):
    return rbac.role_permissions_base(_tables(t), "User")


@query("r02_dag_permissions", PERMISSION_TABLES,
       f"WITH {_dag_views('dag_1', 'dag_2', 'dag_77')} SELECT {big('permission_view_id')} AS permission_view_id FROM dag_views")
def _(t: Get):
    return rbac.dag_permissions(_tables(t), ["dag_1", "dag_2", "dag_77"])


@query("r03_menu_permission", PERMISSION_TABLES,
       f"WITH {MENU} SELECT {big('permission_view_id')} AS permission_view_id FROM menu")
def _(t: Get):
    return rbac.menu_permission(_tables(t))


@query("r03_menu_permission_first", PERMISSION_TABLES, f"""
SELECT {big("MIN(id)")} AS permission_view_id FROM ab_permission_view
WHERE view_menu_id = (SELECT id FROM ab_view_menu WHERE name = 'DAGs')
AND permission_id IN (SELECT id FROM ab_permission WHERE starts_with(name, 'menu'))""")
def _(t: Get):
    return rbac.menu_permission(_tables(t), menu_mode="with_dags")


NEW_PERMISSIONS = f"""WITH {BASE}, {MENU}, {_dag_views('dag_1', 'dag_2')},
everything AS (SELECT permission_view_id FROM base WHERE role_name = 'User' UNION SELECT permission_view_id FROM dag_views
               UNION SELECT permission_view_id FROM menu)
SELECT {big("permission_view_id")} AS permission_view_id, {big("(SELECT MAX(id) + 1 FROM ab_role)")} AS role_id FROM everything"""


@query("r04_derive_role_permissions", PERMISSION_TABLES, NEW_PERMISSIONS)
def _(t: Get):
    return rbac.derive_role(_tables(t), "User", "Restricted", ["dag_1", "dag_2"]).permissions


@query("r04_derive_role", PERMISSION_TABLES, f"SELECT {big('MAX(id) + 1')} AS id, 'Restricted' AS name FROM ab_role")
def _(t: Get):
    return rbac.derive_role(_tables(t), "User", "Restricted", ["dag_1", "dag_2"]).roles


@query("r04_derive_roles_per_nation", [*PERMISSION_TABLES], f"""WITH {BASE}, {MENU},
wanted AS (SELECT 'Nation ' || n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'User' ELSE 'Viewer' END AS source_role,
                  'DAG:dag_' || (n_nationkey % 12) AS view_name FROM nation)
SELECT w.name, {big("b.permission_view_id")} AS permission_view_id FROM wanted w JOIN base b ON b.role_name = w.source_role
UNION SELECT w.name, {big("pv.id")} FROM wanted w JOIN ab_view_menu vm ON vm.name = w.view_name
      JOIN ab_permission_view pv ON pv.view_menu_id = vm.id
UNION SELECT w.name, {big("menu.permission_view_id")} FROM wanted w, menu""")
def _(t: Get):
    requests = t("nation").select(
        F.concat(F.lit("Nation "), "n_name").alias("role_name"),
        F.when(F.col("n_nationkey") % 2 == 0, "User").otherwise("Viewer").alias("source_role"),
        F.array(F.concat(F.lit("dag_"), F.col("n_nationkey") % 12)).alias("specific_dags"),
    )
    new = rbac.derive_roles(_tables(t), requests)
    return new.permissions.join(new.roles.withColumnRenamed("id", "role_id"), "role_id").select("name", "permission_view_id")


@query("r04_derive_roles_refused", ["ab_role"], """
SELECT 'Nation ' || n_name AS role_name, 'No such role' AS source_role, 'unknown source role' AS reason FROM nation
WHERE n_nationkey % 3 = 1
UNION ALL SELECT name, 'User', 'role exists' FROM ab_role""")
def _(t: Get):
    """Two requests for each role: the first one by source counts."""
    source = F.when(F.col("n_nationkey") % 3 == 1, "No such role").otherwise("User")
    nations = t("nation").select(F.concat(F.lit("Nation "), "n_name").alias("role_name"), source.alias("source_role"))
    later = nations.withColumn("source_role", F.lit("Viewer"))
    known = t("ab_role").select(F.col("name").alias("role_name"), F.lit("User").alias("source_role"))
    requests = nations.unionByName(later).unionByName(known).withColumn("specific_dags", F.array(F.lit("dag_1")))
    return rbac.derive_roles(_tables(t), requests).rejected


@query("r04_derive_roles_without_source", [*PERMISSION_TABLES], f"""WITH {MENU}
SELECT 'Nation ' || n_name AS name, {big("pv.id")} AS permission_view_id FROM nation, ab_permission_view pv
WHERE pv.view_menu_id IN (SELECT id FROM ab_view_menu WHERE name = 'DAG:dag_' || (n_nationkey % 12))
UNION SELECT 'Nation ' || n_name, {big("permission_view_id")} FROM nation, menu""")
def _(t: Get):
    """An unknown source, in the mode that makes the role all the same."""
    requests = t("nation").select(
        F.concat(F.lit("Nation "), "n_name").alias("role_name"),
        F.lit("No such role").alias("source_role"),
        F.array(F.concat(F.lit("dag_"), F.col("n_nationkey") % 12)).alias("specific_dags"),
    )
    new = rbac.derive_roles(_tables(t), requests, unknown_source="create")
    return new.permissions.join(new.roles.withColumnRenamed("id", "role_id"), "role_id").select("name", "permission_view_id")


@query("r05_user_roles", ["ab_user", "ab_role", "ab_user_role"], """
SELECT u.username, r.name AS role_name FROM ab_user u JOIN ab_user_role ur ON u.id = ur.user_id
JOIN ab_role r ON r.id = ur.role_id""")
def _(t: Get):
    return rbac.user_roles(_tables(t))


@query("r06_list_roles", ["ab_role"], f"SELECT {big('id')} AS id, name FROM ab_role")
def _(t: Get):
    return rbac.list_roles(_tables(t))


@query("r07_user_exists", ["ab_user"], f"""
SELECT n.name, {big("u.id")} AS id, u.id IS NOT NULL AS found
FROM (SELECT c_mktsegment || '/' || (c_custkey % 900) AS name FROM customer GROUP BY 1) n
LEFT JOIN ab_user u ON u.username = n.name""")
def _(t: Get):
    names = t("customer").select(F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey") % 900).alias("name")).distinct()
    return rbac.existence(_tables(t), names, kind="user")


@query("r07_role_exists", ["ab_role"], f"""
SELECT n.name, {big("r.id")} AS id, r.id IS NOT NULL AS found
FROM (SELECT n_name AS name FROM nation UNION SELECT 'Admin') n LEFT JOIN ab_role r ON r.name = n.name""")
def _(t: Get):
    names = t("nation").select(F.col("n_name").alias("name")).unionByName(
        t("region").where("r_regionkey = 0").select(F.lit("Admin").alias("name"))
    )
    return rbac.existence(_tables(t), names.distinct(), kind="role")


# requests for users: every third customer under its own name, all others under a new one
ASKED = """asked AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '_' END ||
              (c_custkey // 2) ELSE 'new/' || c_custkey END AS username,
         CASE WHEN c_custkey % 4 = 0 THEN 'mail' || c_custkey || '@example.org' END AS email, c_custkey % 3 = 0 AS old
  FROM customer)"""


def _asked(t: Get):
    old = F.col("c_custkey") % 3 == 0
    known = F.concat(
        "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "/").otherwise("_"), F.floor(F.col("c_custkey") / 2)
    )
    mail = F.concat(F.lit("mail"), "c_custkey", F.lit("@example.org"))
    return t("customer").select(
        F.when(old, known).otherwise(F.concat(F.lit("new/"), "c_custkey")).alias("username"),
        F.when(F.col("c_custkey") % 4 == 0, mail).alias("email"),
        F.lit(None).cast("string").alias("first_name"),
        F.lit("").alias("last_name"),
    )


@query("r08_upsert_users", ["ab_user"], f"""WITH {ASKED}
SELECT u.username, u.first_name, u.last_name, COALESCE(a.email, u.email) AS email, u.active
FROM ab_user u LEFT JOIN asked a ON a.username = u.username
UNION ALL SELECT username, username, username, COALESCE(email, replace(username, '/', '_') || '@example.com'), TRUE
FROM asked WHERE NOT old""")
def _(t: Get):
    tables = _tables(t)
    after = rbac.users_after(tables, rbac.upsert_users(tables, _asked(t), as_of=EVENTS_AS_OF))
    return after.select("username", "first_name", "last_name", "email", "active")


@query("r08_upsert_new_ids", ["ab_user"], f"""WITH {ASKED}
SELECT COUNT(*) AS users, {big("MAX(id)")} AS last_id FROM (SELECT (SELECT MAX(id) FROM ab_user) +
  ROW_NUMBER() OVER (ORDER BY username) AS id FROM asked WHERE NOT old)""")
def _(t: Get):
    inserts = rbac.upsert_users(_tables(t), _asked(t), as_of=EVENTS_AS_OF).inserts
    return inserts.agg(F.countDistinct("id").alias("users"), F.max("id").alias("last_id"))


# every second customer moves to one role, some of them to one that does not exist
TARGETS = """targets AS (
  SELECT id AS user_id, username, CASE WHEN id % 10 = 0 THEN 'Nobody' WHEN id % 4 = 0 THEN 'Op' ELSE 'Viewer' END AS role_name
  FROM ab_user WHERE id % 2 = 0)"""


def _targets(t: Get):
    role = F.when(F.col("id") % 10 == 0, "Nobody").when(F.col("id") % 4 == 0, "Op").otherwise("Viewer")
    return t("ab_user").where("id % 2 = 0").select("username", role.alias("role_name"))


@query("r09_replace_user_role", ["ab_user", "ab_role", "ab_user_role"], f"""WITH {TARGETS},
g AS (SELECT t.user_id, r.id AS role_id FROM targets t JOIN ab_role r ON r.name = t.role_name)
SELECT {big("user_id")} AS user_id, {big("role_id")} AS role_id FROM (
  SELECT user_id, role_id FROM ab_user_role WHERE user_id NOT IN (SELECT user_id FROM g) UNION SELECT * FROM g)""")
def _(t: Get):
    return rbac.replace_user_role(_tables(t), _targets(t)).user_roles


@query("r09_replace_user_role_rejected", ["ab_user"], f"""WITH {TARGETS}
SELECT username, role_name FROM targets WHERE role_name = 'Nobody'""")
def _(t: Get):
    return rbac.replace_user_role(_tables(t), _targets(t)).rejected


MAPPED = """memberships AS (SELECT user_id, UNNEST(string_split(translate(groups, '[] ', ''), ',')) AS g FROM logins),
hits AS (SELECT m.user_id, gm.*, ROW_NUMBER() OVER (PARTITION BY m.user_id ORDER BY gm.precedence) AS rn
         FROM memberships m JOIN group_map gm ON gm.idp_group = m.g),
mapped AS (
  SELECT l.user_id, l.username, COALESCE(h.app_role, 'Public') AS app_role,
         COALESCE('arn:aws:iam::123456789012:role/' || h.iam_role, '') AS role_arn, h.specific_dags
  FROM logins l LEFT JOIN hits h ON h.user_id = l.user_id AND h.rn = 1)"""


@query("r10_group_to_role", ["logins", "group_map"], f"""WITH {MAPPED}
SELECT {big("user_id")} AS user_id, app_role, role_arn, array_to_string(specific_dags, ',') AS specific_dags FROM mapped""")
def _(t: Get):
    return rbac.group_to_role(t("logins"), t("group_map"), account_id="123456789012")


@query("r11_needs_custom_role", ["logins", "group_map"], f"""WITH {MAPPED}
SELECT {big("user_id")} AS user_id, app_role, app_role NOT IN ('Admin', 'Op', 'User', 'Viewer') AS needs_custom_role
FROM mapped""")
def _(t: Get):
    assigned = rbac.group_to_role(t("logins"), t("group_map"))
    return rbac.needs_custom_role(assigned).select("user_id", "app_role", "needs_custom_role")


PROVISIONED = f"""WITH {MAPPED},
custom AS (SELECT * FROM mapped WHERE app_role NOT IN ('Admin', 'Op', 'User', 'Viewer'))"""


@query("r12_provision_batch_user_roles", ["logins", "group_map", "ab_user", "ab_role", "ab_user_role"], f"""{PROVISIONED}
SELECT u.username, COALESCE(c.app_role, r.name) AS role_name
FROM ab_user u JOIN ab_user_role ur ON ur.user_id = u.id JOIN ab_role r ON r.id = ur.role_id
LEFT JOIN custom c ON c.username = u.username""")
def _(t: Get):
    checkpoint_folder(t("logins").sparkSession)
    after = rbac.provision_batch(_tables(t), t("logins"), t("group_map"), as_of=EVENTS_AS_OF, settle=True)
    tables = {"ab_user": after.ab_user, "ab_role": after.ab_role, "ab_user_role": after.ab_user_role}
    return rbac.user_roles(tables)


@query("r12_provision_batch_permissions", [*PERMISSION_TABLES], f"""WITH {BASE}, {_dag_views('dag_1', 'dag_2')}, {MENU}
SELECT {big("permission_view_id")} AS permission_view_id FROM (
  SELECT permission_view_id FROM base WHERE role_name = 'User' UNION SELECT permission_view_id FROM dag_views
  UNION SELECT permission_view_id FROM menu)""")
def _(t: Get):
    checkpoint_folder(t("logins").sparkSession)
    after = rbac.provision_batch(_tables(t), t("logins"), t("group_map"), as_of=EVENTS_AS_OF, settle=True)
    added = after.ab_role.where(F.col("name") == "Restricted").select(F.col("id").alias("role_id"))
    return after.ab_permission_view_role.join(added, "role_id").select("permission_view_id")


@query("r12_provision_two_mappings", [*PERMISSION_TABLES], f"""WITH {BASE}, {_dag_views('dag_7')}, {MENU}
SELECT {big("permission_view_id")} AS permission_view_id FROM (
  SELECT permission_view_id FROM base WHERE role_name = 'User' UNION SELECT permission_view_id FROM dag_views
  UNION SELECT permission_view_id FROM menu)""")
def _(t: Get):
    """Half of the logins come by a second, earlier mapping to the same role: the role gets that mapping's list."""
    logins, mapped = t("logins"), t("group_map")
    second = mapped.where(F.col("app_role") == "Restricted").limit(1).select(
        F.lit(-1).cast(mapped.schema["precedence"].dataType).alias("precedence"),
        F.lit("second_group").alias("idp_group"),
        "iam_role",
        "app_role",
        F.array(F.lit("dag_7")).alias("specific_dags"),
    )
    groups = F.when(F.col("user_id") % 2 == 0, F.col("groups")).otherwise(F.lit("[second_group]"))
    after = rbac.provision_batch(
        _tables(t), logins.withColumn("groups", groups), mapped.unionByName(second), as_of=EVENTS_AS_OF
    )
    added = after.ab_role.where(F.col("name") == "Restricted").select(F.col("id").alias("role_id"))
    return after.ab_permission_view_role.join(added, "role_id").select("permission_view_id")


CLEAN = "replace(username, '/', '_')"


def _names(t: Get, **columns):
    users = t("ab_user")
    return users.select("id", *[c.alias(n) for n, c in columns.items()])


ID = big("id") + " AS id"


@query("u01_sanitize_username", ["ab_user"], f"SELECT {ID}, {CLEAN} AS username, replace(username, '/', '-') AS dashed FROM ab_user")
def _(t: Get):
    return _names(t, username=identity.sanitize_username("username"), dashed=identity.sanitize_username("username", "-"))


@query("u02_reject_invalid", ["ab_user"], f"SELECT {ID}, username FROM ab_user WHERE contains(username, '/')")
def _(t: Get):
    return identity.split_valid(t("ab_user"))[1].select("id", "username")


NOISY = "username || CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN ' a:b' WHEN 1 THEN '*?' WHEN 2 THEN '<\"x\">' ELSE '|\\é.' END"


def _noisy():
    return F.concat(
        "username",
        F.when(F.col("id") % 4 == 0, " a:b").when(F.col("id") % 4 == 1, "*?").when(F.col("id") % 4 == 2, '<"x">').otherwise(
            "|\\é."
        ),
    )


@query("u03_multi_char", ["ab_user"], f"""SELECT {ID}, translate({NOISY}, '/\\ :*?"<>|', '__________') AS username FROM ab_user""")
def _(t: Get):
    return _names(t, username=identity.sanitize_special(_noisy()))


@query("u04_lowercase", ["ab_user"], f"SELECT {ID}, lower({CLEAN}) AS username FROM ab_user")
def _(t: Get):
    return _names(t, username=identity.sanitize_lower("username"))


@query("u05_max_length", ["ab_user"], f"SELECT {ID}, left({CLEAN}, 10) AS username FROM ab_user")
def _(t: Get):
    return _names(t, username=identity.sanitize_short("username", 10))


@query("u06_domain_prefix", ["ab_user"], f"""
SELECT {ID}, CASE WHEN contains(username, '/') THEN substr(username, strpos(username, '/') + 1) || '@' ||
       substr(username, 1, strpos(username, '/') - 1) ELSE username END AS username FROM ab_user""")
def _(t: Get):
    return _names(t, username=identity.domain_to_suffix("username"))


@query("u07_whitelist", ["ab_user"], f"SELECT {ID}, regexp_replace({NOISY}, '[^a-zA-Z0-9_.-]', '_', 'g') AS username FROM ab_user")
def _(t: Get):
    return _names(t, username=identity.sanitize_whitelist(_noisy()))


@query("u08_keep_original", ["ab_user"], f"""
SELECT {ID}, {CLEAN} AS username, CASE WHEN contains(username, '/') AND first_name = '' THEN 'Original: ' || username
       ELSE first_name END AS first_name FROM ab_user""")
def _(t: Get):
    return _names(
        t,
        username=identity.sanitize_username("username"),
        first_name=identity.keep_original("username", "first_name"),
    )


@query("u09_email_based", ["ab_user"], f"""
SELECT {ID}, CASE WHEN NOT contains(username, '/') THEN username WHEN id % 5 = 0 THEN {CLEAN}
       ELSE replace(split_part(email, '@', 1), '.', '_') END AS username FROM ab_user""")
def _(t: Get):
    email = F.when(F.col("id") % 5 != 0, F.col("email"))
    return _names(t, username=identity.username_from_email("username", email))


@query("u10_role_conditional", ["ab_user", "ab_user_role"], f"""
SELECT {big("u.id")} AS id, CASE WHEN ur.role_id = 1 THEN replace(username, '/', '@') ELSE {CLEAN} END AS username
FROM ab_user u JOIN ab_user_role ur ON ur.user_id = u.id""")
def _(t: Get):
    with_roles = rbac.user_roles(_tables(t)).groupBy("username").agg(F.collect_set("role_name").alias("roles"))
    users = t("ab_user").join(with_roles, "username")
    return users.select("id", identity.sanitize_by_role("username", "roles").alias("username"))


@query("u11_audit_log", ["ab_user", "ab_role", "ab_user_role"], f"""
SELECT {NOW} AS "timestamp", 'user_created' AS action, u.username, u.email, COALESCE(r.name, '') AS roles,
       CASE WHEN u.id % 2 = 0 THEN 'admin' ELSE 'system' END AS created_by
FROM ab_user u LEFT JOIN ab_user_role ur ON ur.user_id = u.id LEFT JOIN ab_role r ON r.id = ur.role_id""")
def _(t: Get):
    users = t("ab_user").withColumn("created_by", F.when(F.col("id") % 2 == 0, "admin"))
    return identity.audit_log(users, rbac.user_roles(_tables(t)), as_of=EVENTS_AS_OF)


@query("u11_rename_log", ["ab_user"], f"""
SELECT username AS original_username, {CLEAN} AS username FROM ab_user WHERE contains(username, '/')""")
def _(t: Get):
    return identity.rename_log(t("ab_user"))


@query("u12_collisions", ["ab_user"], f"""
SELECT {CLEAN} AS username, COUNT(DISTINCT username) AS users, MIN(username) AS first_original
FROM ab_user GROUP BY {CLEAN} HAVING COUNT(DISTINCT username) > 1""")
def _(t: Get):
    return identity.collisions(t("ab_user"), identity.sanitize_username("username"))


# One request per customer: kinds by id % 8. Kind 5 wants the address of the next user, kind 6 sends a mask with a
# field that is missing, kind 7 an unknown role, kind 4 names nobody.
PATCHES = """patches AS (
  SELECT id AS request_id, CASE WHEN id % 8 = 4 THEN 'nobody' || id ELSE username END AS username,
         CASE WHEN id % 8 = 0 THEN 'renamed' || id WHEN id % 8 = 1 THEN
              (SELECT MIN(username) FROM ab_user) END AS new_username,
         CASE WHEN id % 8 = 2 THEN 'new' || id || '@example.org' END AS new_email, id % 8 AS kind, id
  FROM ab_user)"""


def _patches(t: Get):
    kind, users = F.col("id") % 8, t("ab_user")
    first = users.agg(F.min("username")).scalar()
    text = F.lit(None).cast("string")
    return users.select(
        F.col("id").alias("request_id"),
        F.when(kind == 4, F.concat(F.lit("nobody"), "id")).otherwise(F.col("username")).alias("username"),
        F.when(kind == 0, F.concat(F.lit("renamed"), "id")).when(kind == 1, first).alias("new_username"),
        F.when(kind == 2, F.concat(F.lit("new"), "id", F.lit("@example.org"))).when(kind == 5, F.lit("customer#000000001@example.com")).alias("new_email"),
        text.alias("new_first_name"),
        F.when(kind == 3, F.lit("Patched")).alias("new_last_name"),
        F.lit(None).cast("boolean").alias("new_active"),
        F.when(kind == 7, F.array(F.lit("Nobody"), F.lit("Op"))).when(kind == 3, F.array(F.lit("Op"))).alias("new_roles"),
        F.when(kind == 6, F.lit("email, last_name")).when(kind == 3, F.lit("last_name,roles")).alias("update_mask"),
    )


REFUSED = f"""refused AS (
  SELECT p.request_id, p.username, CASE
      WHEN kind = 4 THEN 404
      WHEN kind = 1 AND p.username <> (SELECT MIN(username) FROM ab_user) THEN 409
      WHEN kind = 5 AND u.email <> 'customer#000000001@example.com' THEN 409
      WHEN kind IN (6, 7) THEN 400 END AS code,
    CASE kind WHEN 4 THEN 'no user ' || p.username WHEN 1 THEN 'username taken: ' || (SELECT MIN(username) FROM ab_user)
      WHEN 5 THEN 'email taken: customer#000000001@example.com' WHEN 6 THEN 'not sent: email, last_name'
      WHEN 7 THEN 'unknown roles: Nobody' END AS detail
  FROM patches p LEFT JOIN ab_user u ON u.username = p.username)"""


@query("u13_patch_users", ["ab_user"], f"""WITH {PATCHES}, {REFUSED}
SELECT {big("u.id")} AS id, CASE WHEN p.kind = 0 THEN p.new_username ELSE u.username END AS username, u.first_name,
       CASE WHEN p.kind = 3 THEN 'Patched' ELSE u.last_name END AS last_name,
       CASE WHEN p.kind = 2 THEN p.new_email ELSE u.email END AS email, u.active
FROM patches p JOIN refused r USING (request_id) JOIN ab_user u ON u.id = p.id WHERE r.code IS NULL""")
def _(t: Get):
    changed = identity.patch_users(t("ab_user"), t("ab_role"), _patches(t)).users
    return changed.select("id", "username", "first_name", "last_name", "email", "active")


@query("u13_patch_users_rejected", ["ab_user"], f"""WITH {PATCHES}, {REFUSED}
SELECT {big("request_id")} AS request_id, username, {big("code")} AS code, detail FROM refused WHERE code IS NOT NULL""")
def _(t: Get):
    return identity.patch_users(t("ab_user"), t("ab_role"), _patches(t)).rejected


@query("u13_patch_users_roles", ["ab_user"], f"""
SELECT {big("id")} AS user_id, {big("2")} AS role_id FROM ab_user WHERE id % 8 = 3""")
def _(t: Get):
    return identity.patch_users(t("ab_user"), t("ab_role"), _patches(t)).user_roles


def _wanted(t: Get):
    return t("ab_user").where("id % 3 = 0").select(
        F.when(F.col("id") % 2 == 0, F.col("username")).otherwise(F.concat("username", F.lit("?"))).alias("username")
    )


@query("u14_lookup_users", ["ab_user"], f"SELECT {ID}, username FROM ab_user WHERE id % 6 = 0")
def _(t: Get):
    return identity.lookup_users(t("ab_user"), _wanted(t))[0].select("id", "username")


@query("u14_lookup_missing", ["ab_user"], "SELECT username || '?' AS username FROM ab_user WHERE id % 6 = 3")
def _(t: Get):
    return identity.lookup_users(t("ab_user"), _wanted(t))[1]


@query("u14_delete_users", ["ab_user"], f"SELECT {ID}, username FROM ab_user WHERE id % 6 <> 0")
def _(t: Get):
    left = identity.delete_users(t("ab_user"), t("ab_user_role"), _wanted(t))
    return left.users.select("id", "username")


@query("u14_delete_user_roles", ["ab_user_role"], f"""
SELECT {big("user_id")} AS user_id, {big("role_id")} AS role_id FROM ab_user_role WHERE user_id % 6 <> 0""")
def _(t: Get):
    return identity.delete_users(t("ab_user"), t("ab_user_role"), _wanted(t)).user_roles
