"""Roles and permissions as set algebra over the ``ab_*`` tables.

``tables`` maps table names (ab_user, ab_role, ab_user_role, ab_permission, ab_view_menu, ab_permission_view,
ab_permission_view_role) to DataFrames. Operators return the rows to write; they never write themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import salted_join, with_row_numbers
from ..functions.text import group_list
from ..functions.timeexpr import AsOf, timestamp_lit
from ..plans.settle import settled

Tables = Mapping[str, DataFrame]

# fixed values: roles that need no provisioning, and the role of users without a mapping
STANDARD_ROLES = ["Admin", "Op", "User", "Viewer"]
DEFAULT_ROLE = "Public"


def _views(tables: Tables) -> DataFrame:
    """Permission views with the names of view and permission; how the small tables are joined is left to Spark."""
    pv = tables["ab_permission_view"].select(F.col("id").alias("permission_view_id"), "permission_id", "view_menu_id")
    vm = tables["ab_view_menu"].select(F.col("id").alias("view_menu_id"), F.col("name").alias("view_name"))
    p = tables["ab_permission"].select(F.col("id").alias("permission_id"), F.col("name").alias("permission_name"))
    return pv.join(vm, "view_menu_id").join(p, "permission_id")


def _is_dag_view() -> Column:
    return F.col("view_name").startswith("DAG:") | F.col("view_name").startswith("DAGs")


def _menu_views(menu_mode: str) -> Column:
    if menu_mode not in ("always", "with_dags"):
        raise ValueError(f"menu_mode must be 'always' or 'with_dags', not {menu_mode!r}")
    name = F.col("permission_name")
    return (F.col("view_name") == "DAGs") & (name == "menu_access" if menu_mode == "always" else name.startswith("menu"))


def _base_permissions(tables: Tables, roles: DataFrame) -> DataFrame:
    """(role_name, permission_view_id) of ``roles`` (one column, role_name), without workflow views."""
    role = tables["ab_role"].select(F.col("id").alias("role_id"), F.col("name").alias("role_name"))
    wanted = role.join(roles.distinct(), "role_name", "left_semi")
    held = tables["ab_permission_view_role"].join(wanted, "role_id").select("role_name", "permission_view_id")
    views = _views(tables).where(~_is_dag_view()).select("permission_view_id")
    return held.join(views, "permission_view_id", "left_semi").distinct()


def _granting_views(tables: Tables, menu_mode: str) -> DataFrame:
    """(grant, permission_view_id): what each grant consists of, every table read once.

    ``role:<name>`` is what a role holds without workflow views, ``view:<name>`` the views on a page, ``menu`` the
    smallest id that opens the menu.
    """
    links = tables["ab_permission_view_role"].select("permission_view_id", "role_id")
    names = tables["ab_role"].select(F.col("id").alias("role_id"), F.col("name").alias("role_name"))
    views = _views(tables).join(links.join(names, "role_id"), "permission_view_id", "left")
    grants = F.array(
        F.when(~_is_dag_view(), F.concat(F.lit("role:"), "role_name")),
        F.when(_is_dag_view(), F.concat(F.lit("view:"), "view_name")),
        F.when(_menu_views(menu_mode), F.lit("menu")),
    )
    each = views.select("permission_view_id", F.explode(F.array_compact(grants)).alias("grant"))
    one_of_menu = F.when(F.col("grant") != "menu", F.col("permission_view_id"))
    return each.groupBy("grant", one_of_menu.alias("_one")).agg(F.min("permission_view_id").alias("permission_view_id")).drop("_one")


def _one_column(tables: Tables, values: Sequence[str], name: str) -> DataFrame:
    spark = tables["ab_role"].sparkSession
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def role_permissions_base(tables: Tables, source_role: str) -> DataFrame:
    """Permission views of a role, workflow views left out."""
    return _base_permissions(tables, _one_column(tables, [source_role], "role_name")).select("permission_view_id")


def dag_permissions(tables: Tables, dag_ids: Sequence[str] | DataFrame) -> DataFrame:
    """Permission views on the given workflows (a list, or a DataFrame with column dag_id)."""
    ids = dag_ids if isinstance(dag_ids, DataFrame) else _one_column(tables, dag_ids, "dag_id")
    names = ids.select(F.concat(F.lit("DAG:"), "dag_id").alias("view_name")).distinct()
    menus = tables["ab_view_menu"].withColumnRenamed("name", "view_name").join(names, "view_name", "left_semi")
    views = tables["ab_permission_view"].select(F.col("id").alias("permission_view_id"), "view_menu_id")
    menu_ids = menus.select(F.col("id").alias("view_menu_id"))
    return salted_join(views, menu_ids, ["view_menu_id"], ["permission_view_id"], "left_semi").select("permission_view_id")


def menu_permission(tables: Tables, *, menu_mode: str = "always") -> DataFrame:
    """The permission to see the workflow menu.

    ``always``: menu_access on DAGs. ``with_dags``: the first one whose permission starts with "menu".
    """
    menu = _views(tables).where(_menu_views(menu_mode))
    if menu_mode == "always":
        return menu.select("permission_view_id")
    first = menu.agg(F.min("permission_view_id").alias("permission_view_id"))
    return first.where(F.col("permission_view_id").isNotNull())


class NewRoles(NamedTuple):
    """Rows to append to ab_role (id, name) and ab_permission_view_role (permission_view_id, role_id), and the requests
    that are refused (role_name, source_role, reason)."""

    roles: DataFrame
    permissions: DataFrame
    rejected: DataFrame


def derive_roles(
    tables: Tables, requests: DataFrame, *, menu_mode: str = "always", unknown_source: str = "reject"
) -> NewRoles:
    """New roles from ``requests``: role_name, source_role, specific_dags (array or null).

    Each role gets the base permissions of its source, those on its workflows and the menu permission. Of several
    requests for one role the first by source, then by workflow list, goes. Roles that exist already are refused, and
    so are requests for an unknown source, unless ``unknown_source="create"``: then the role is made with workflow and
    menu permissions only. Ids go on from the largest one.
    """
    if unknown_source not in ("reject", "create"):
        raise ValueError(f"unknown_source must be 'reject' or 'create', not {unknown_source!r}")
    roles = tables["ab_role"]
    names = roles.select(F.col("name").alias("role_name"))
    asked = requests.groupBy("role_name").agg(F.min(F.struct("source_role", "specific_dags")).alias("first"))
    asked = (
        asked.select("role_name", "first.*")
        .join(names.select("role_name", F.lit(True).alias("exists")).distinct(), "role_name", "left")
        .join(
            names.select(F.col("role_name").alias("source_role"), F.lit(True).alias("has_source")).distinct(),
            "source_role",
            "left",
        )
    )
    reason = F.when(F.col("exists"), F.lit("role exists"))
    if unknown_source == "reject":
        reason = reason.when(F.col("has_source").isNull(), F.lit("unknown source role"))
    judged = asked.withColumn("reason", reason)
    wanted = judged.where(F.col("reason").isNull())
    last_id = F.coalesce(roles.agg(F.max("id")).scalar(), F.lit(0))
    named = with_row_numbers(wanted, ["role_name"], "_no").withColumn("role_id", (last_id + F.col("_no")).cast("int"))

    dags = F.coalesce("specific_dags", F.array().cast("array<string>"))
    has_menu = F.lit(True) if menu_mode == "always" else F.size(dags) > 0
    grants = F.concat(
        F.array(F.concat(F.lit("role:"), "source_role"), F.when(has_menu, F.lit("menu"))),
        F.transform(dags, lambda d: F.concat(F.lit("view:DAG:"), d)),
    )
    each = named.select("role_id", F.explode(F.array_compact(grants)).alias("grant"))
    # most new roles may share one source or one workflow, so this join is split by role
    permissions = salted_join(each, _granting_views(tables, menu_mode), ["grant"], ["role_id"])
    return NewRoles(
        named.select(F.col("role_id").alias("id"), F.col("role_name").alias("name")),
        permissions.select("permission_view_id", "role_id").distinct(),
        judged.where(F.col("reason").isNotNull()).select("role_name", "source_role", "reason"),
    )


def derive_role(
    tables: Tables,
    source_role: str,
    target_role: str,
    dag_ids: Sequence[str] = (),
    *,
    menu_mode: str = "always",
    on_existing: str = "error",
    unknown_source: str = "reject",
) -> NewRoles:
    """One new role from ``source_role``; an existing target raises, or is left alone with ``on_existing="skip"``.

    To raise, the role table is asked at once; with ``skip`` nothing runs until the result is used.
    """
    if on_existing not in ("error", "skip"):
        raise ValueError(f"on_existing must be 'error' or 'skip', not {on_existing!r}")
    if on_existing == "error" and not tables["ab_role"].where(F.col("name") == target_role).isEmpty():
        raise ValueError(f"role {target_role!r} exists already")
    request = tables["ab_role"].sparkSession.createDataFrame(
        [(target_role, source_role, list(dag_ids))], "role_name string, source_role string, specific_dags array<string>"
    )
    return derive_roles(tables, request, menu_mode=menu_mode, unknown_source=unknown_source)


def user_roles(tables: Tables, usernames: Sequence[str] | None = None) -> DataFrame:
    """(username, role_name) of all or some users."""
    users = tables["ab_user"].select(F.col("id").alias("user_id"), "username")
    if usernames is not None:
        users = users.where(F.col("username").isin(*usernames))
    roles = tables["ab_role"].select(F.col("id").alias("role_id"), F.col("name").alias("role_name"))
    links = tables["ab_user_role"].select("user_id", "role_id")
    with_role = salted_join(links, roles, ["role_id"], ["user_id"])
    return with_role.join(users, "user_id").select("username", "role_name")


def list_roles(tables: Tables) -> DataFrame:
    return tables["ab_role"].select("id", "name").orderBy("name", "id")


def existence(tables: Tables, names: DataFrame, *, kind: str) -> DataFrame:
    """Adds ``id`` and ``found`` to ``names`` (column name); ``kind`` is user or role."""
    table, column = {"user": ("ab_user", "username"), "role": ("ab_role", "name")}[kind]
    known = tables[table].select(F.col(column).alias("name"), "id")
    return names.join(known, "name", "left").withColumn("found", F.col("id").isNotNull())


class UserChanges(NamedTuple):
    """Rows to insert and full rows to replace in ab_user."""

    inserts: DataFrame
    updates: DataFrame


def upsert_users(
    tables: Tables, requests: DataFrame, *, as_of: AsOf, safe_email: bool = True, update_existing: bool = True
) -> UserChanges:
    """Users for ``requests``: username, email, first_name, last_name (the last three may be null or empty).

    New users get their username as names and a made-up address (slashes replaced unless ``safe_email`` is off);
    existing ones only the fields given. Several requests for one name count as one.
    """
    given = lambda c: F.max(F.nullif(F.col(c), F.lit(""))).alias(f"new_{c}")
    fields = ["email", "first_name", "last_name"]
    asked = requests.groupBy("username").agg(*[given(c) for c in fields])
    users = tables["ab_user"]
    local = F.translate("username", "/", "_") if safe_email else F.col("username")
    now = timestamp_lit(as_of)
    fresh = with_row_numbers(asked.join(users.select("username"), "username", "left_anti"), ["username"], "_no")
    last_id = F.coalesce(users.agg(F.max("id")).scalar(), F.lit(0))
    inserts = fresh.select(
        (last_id + F.col("_no")).cast(users.schema["id"].dataType).alias("id"),
        "username",
        F.coalesce("new_first_name", "username").alias("first_name"),
        F.coalesce("new_last_name", "username").alias("last_name"),
        F.coalesce("new_email", F.concat(local, F.lit("@example.com"))).alias("email"),
        F.lit(True).alias("active"),
        now.alias("created_on"),
        now.alias("changed_on"),
    )
    has_news = F.coalesce(*[f"new_{c}" for c in fields]).isNotNull() & F.lit(update_existing)
    updates = users.join(asked, "username").where(has_news)
    for c in fields:
        updates = updates.withColumn(c, F.coalesce(f"new_{c}", c))
    return UserChanges(inserts, updates.select(*users.columns))


def users_after(tables: Tables, changes: UserChanges) -> DataFrame:
    """ab_user with ``changes`` applied."""
    users = tables["ab_user"]
    kept = users.join(changes.updates.select("id"), "id", "left_anti").select(*users.columns)
    return kept.unionByName(changes.updates).unionByName(changes.inserts.select(*users.columns))


class RoleChanges(NamedTuple):
    """ab_user_role after the change, and the requests whose role or user is unknown."""

    user_roles: DataFrame
    rejected: DataFrame


class Granted(NamedTuple):
    """The only role of each user named (user_id, role_id), and the requests whose role or user is unknown."""

    links: DataFrame
    rejected: DataFrame


def granted_roles(tables: Tables, targets: DataFrame) -> Granted:
    """The roles that ``targets`` (username, role_name) give; of several for one user the first by name."""
    roles = tables["ab_role"].select(F.col("name").alias("role_name"), F.col("id").alias("role_id"))
    users = tables["ab_user"].select("username", F.col("id").alias("user_id"))
    asked = targets.groupBy("username").agg(F.min("role_name").alias("role_name"))
    resolved = salted_join(asked.join(users, "username", "left"), roles, ["role_name"], ["username"], "left")
    is_known = F.col("role_id").isNotNull() & F.col("user_id").isNotNull()
    rejected = resolved.where(~is_known).select("username", "role_name")
    return Granted(resolved.where(is_known).select("user_id", "role_id"), rejected)


def replace_user_role(tables: Tables, targets: DataFrame) -> RoleChanges:
    """Gives each user of ``targets`` (username, role_name) exactly that role."""
    return _with_links(tables, granted_roles(tables, targets))


def _with_links(tables: Tables, granted: Granted) -> RoleChanges:
    links = tables["ab_user_role"].select("user_id", "role_id")
    untouched = salted_join(links, granted.links.select("user_id"), ["user_id"], ["role_id"], "left_anti")
    return RoleChanges(untouched.unionByName(granted.links).distinct(), granted.rejected)


def group_to_role(
    logins: DataFrame, group_map: DataFrame, *, account_id: str = "", default_role: str = DEFAULT_ROLE
) -> DataFrame:
    """Role of each login: the first mapping, by precedence, whose group is in the login's list.

    ``logins``: user_id and groups; ``group_map``: precedence, idp_group, iam_role, app_role, specific_dags.
    """
    return _first_mapping(logins, group_map, account_id, default_role).drop("precedence")


def _first_mapping(logins: DataFrame, group_map: DataFrame, account_id: str, default_role: str) -> DataFrame:
    member_of = logins.select("user_id", F.explode_outer(group_list("groups")).alias("idp_group"))
    mapped = salted_join(member_of, group_map, ["idp_group"], ["user_id"], "left")
    best = F.min_by(F.struct("iam_role", "app_role", "specific_dags", F.lit(True).alias("mapped")), "precedence")
    arn = F.concat(F.lit(f"arn:aws:iam::{account_id}:role/"), F.col("best.iam_role"))
    return (
        mapped.groupBy("user_id")
        .agg(best.alias("best"), F.min("precedence").alias("precedence"))
        .select(
            "user_id",
            F.coalesce("best.app_role", F.lit(default_role)).alias("app_role"),
            F.coalesce(arn, F.lit("")).alias("role_arn"),
            F.col("best.specific_dags").alias("specific_dags"),
            "precedence",
        )
    )


def needs_custom_role(assigned: DataFrame) -> DataFrame:
    """Adds whether the role has to be provisioned."""
    return assigned.withColumn("needs_custom_role", ~F.col("app_role").isin(*STANDARD_ROLES))


class Provisioned(NamedTuple):
    """What a batch of logins changes: roles and permissions to add, users to add or replace, and the links of users."""

    new: NewRoles
    users: UserChanges
    granted: Granted


def provision_changes(
    tables: Tables,
    logins: DataFrame,
    group_map: DataFrame,
    *,
    as_of: AsOf,
    source_role: str = "User",
    unknown_source: str = "reject",
    settle: bool = False,
) -> Provisioned:
    """Roles, users and role links for a table of logins (user_id, username, groups) that need a custom role.

    Where mappings to one role name different workflows, the role gets the list of the mapping with the lowest
    precedence among the logins (then of the smallest user), as its first login would. Logins whose role cannot be made
    are rejected. Each step builds on the one before; ``settle`` computes each once and keeps its rows in the checkpoint
    folder, instead of planning all before it again in each result.
    """
    keep = settled if settle else lambda df: df
    assigned = needs_custom_role(_first_mapping(logins, group_map, "", DEFAULT_ROLE)).where("needs_custom_role")
    who = keep(logins.select("user_id", "username").distinct().join(assigned, "user_id"))
    requests = who.groupBy(F.col("app_role").alias("role_name")).agg(
        F.lit(source_role).alias("source_role"),
        F.min_by("specific_dags", F.struct("precedence", "user_id")).alias("specific_dags"),
    )
    new = derive_roles(tables, requests, menu_mode="with_dags", unknown_source=unknown_source)
    new = new._replace(roles=keep(new.roles))
    name = F.col("username")
    people = who.select(
        "username", F.lit(None).cast("string").alias("email"), name.alias("first_name"), name.alias("last_name")
    )
    users = upsert_users(tables, people, as_of=as_of, safe_email=False)
    users = users._replace(inserts=keep(users.inserts))
    roles = tables["ab_role"].select("id", "name").unionByName(new.roles)
    # ids and names are enough here; a changed user keeps both
    known = tables["ab_user"].select("id", "username").unionByName(users.inserts.select("id", "username"))
    after = {**tables, "ab_role": roles, "ab_user": known}
    targets = who.select("username", F.col("app_role").alias("role_name"))
    granted = granted_roles(after, targets)
    return Provisioned(new, users, granted._replace(links=keep(granted.links)))


class Provisioning(NamedTuple):
    """All tables after a batch of logins, plus the rejected role changes."""

    ab_role: DataFrame
    ab_permission_view_role: DataFrame
    ab_user: DataFrame
    ab_user_role: DataFrame
    rejected: DataFrame


def provision_batch(tables: Tables, logins: DataFrame, group_map: DataFrame, **options) -> Provisioning:
    """The tables after ``provision_changes`` (which takes the same options)."""
    changes = provision_changes(tables, logins, group_map, **options)
    links = _with_links(tables, changes.granted)
    return Provisioning(
        tables["ab_role"].select("id", "name").unionByName(changes.new.roles),
        tables["ab_permission_view_role"].select("permission_view_id", "role_id").unionByName(changes.new.permissions),
        users_after(tables, changes.users),
        links.user_roles,
        links.rejected,
    )
