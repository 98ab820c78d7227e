"""Username cleaning as column expressions (batch and streaming) and user-table changes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import salted_join
from ..functions.timeexpr import AsOf, timestamp_lit

# fixed values: characters replaced by the wide rule
SPECIAL_CHARACTERS = "/\\ :*?\"<>|"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize_username(name: str | Column, replacement: str = "_") -> Column:
    return F.replace(_col(name), F.lit("/"), F.lit(replacement))


def has_slash(name: str | Column) -> Column:
    """True for usernames the strict rule rejects."""
    return _col(name).contains("/")


def sanitize_special(name: str | Column, replacement: str = "_") -> Column:
    return F.translate(_col(name), SPECIAL_CHARACTERS, replacement * len(SPECIAL_CHARACTERS))


def sanitize_lower(name: str | Column) -> Column:
    return F.lower(sanitize_username(name))


def sanitize_short(name: str | Column, max_length: int = 50) -> Column:
    return F.substring(sanitize_username(name), 1, max_length)


def domain_to_suffix(name: str | Column) -> Column:
    """``DOMAIN/user`` to ``user@DOMAIN``, at the first slash."""
    n = _col(name)
    parts = F.split(n, "/", 2)
    return F.when(n.contains("/"), F.concat(F.get(parts, F.lit(1)), F.lit("@"), F.get(parts, F.lit(0)))).otherwise(n)


def sanitize_whitelist(name: str | Column) -> Column:
    return F.regexp_replace(_col(name), r"[^a-zA-Z0-9_\-.]", "_")


def keep_original(name: str | Column, first_name: str | Column) -> Column:
    """First name to store: the original username where it changes and no first name is given."""
    n, first = _col(name), _col(first_name)
    is_free = first.isNull() | (first == "")
    return F.when(has_slash(n) & is_free, F.concat(F.lit("Original: "), n)).otherwise(first)


def username_from_email(name: str | Column, email: str | Column) -> Column:
    """The address's local part, dots replaced, for usernames with a slash."""
    n, mail = _col(name), _col(email)
    local = F.translate(F.substring_index(mail, "@", 1), ".", "_")
    return (
        F.when(has_slash(n) & F.coalesce(mail.contains("@"), F.lit(False)), local)
        .when(has_slash(n), sanitize_username(n))
        .otherwise(n)
    )


def sanitize_by_role(name: str | Column, roles: str | Column) -> Column:
    """Slashes become ``@`` for admins and ``_`` for everyone else."""
    is_admin = F.coalesce(F.array_contains(_col(roles), "Admin"), F.lit(False))
    return F.when(is_admin, sanitize_username(name, "@")).otherwise(sanitize_username(name))


def split_valid(users: DataFrame, *, username: str = "username") -> tuple[DataFrame, DataFrame]:
    """Users the strict rule accepts, and those it rejects."""
    bad = F.coalesce(has_slash(username), F.lit(False))
    return users.where(~bad), users.where(bad)


def with_clean_username(users: DataFrame, *, username: str = "username") -> DataFrame:
    """Replaces the username, keeping the old one as ``original_username``."""
    return users.withColumn("original_username", F.col(username)).withColumn(username, sanitize_username(username))


def rename_log(users: DataFrame, *, username: str = "username") -> DataFrame:
    """One row per username that cleaning changes."""
    return users.where(has_slash(username)).select(
        F.col(username).alias("original_username"), sanitize_username(username).alias("username")
    )


def audit_log(users: DataFrame, user_roles: DataFrame, *, as_of: AsOf) -> DataFrame:
    """One entry per created user with the sorted names of its roles (bounded by the role table).

    ``users``: username, email, created_by (may be null); ``user_roles``: username, role_name.
    """
    names = user_roles.distinct().groupBy("username").agg(F.array_sort(F.collect_set("role_name")).alias("roles"))
    return users.join(names, "username", "left").select(
        timestamp_lit(as_of).alias("timestamp"),
        F.lit("user_created").alias("action"),
        "username",
        "email",
        F.coalesce("roles", F.array().cast("array<string>")).alias("roles"),
        F.coalesce("created_by", F.lit("system")).alias("created_by"),
    )


def collisions(users: DataFrame, cleaned: Column, *, username: str = "username") -> DataFrame:
    """Cleaned names shared by several usernames."""
    return (
        users.select(cleaned.alias("username"), F.col(username).alias("_original"))
        .groupBy("username")
        .agg(F.countDistinct("_original").alias("users"), F.min("_original").alias("first_original"))
        .where(F.col("users") > 1)
    )


def lookup_users(users: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users whose exact name is in ``names`` (column username), and the names not found."""
    wanted = names.select("username").distinct()
    return users.join(wanted, "username", "left_semi"), wanted.join(users.select("username"), "username", "left_anti")


class Deletion(NamedTuple):
    users: DataFrame
    user_roles: DataFrame
    not_found: DataFrame


def delete_users(users: DataFrame, user_roles: DataFrame, names: DataFrame) -> Deletion:
    """Users and role links without the named users, and the names not found."""
    gone, not_found = lookup_users(users, names)
    return Deletion(
        users.join(gone.select("id"), "id", "left_anti").select(*users.columns),
        user_roles.join(gone.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(*user_roles.columns),
        not_found,
    )


PATCH_FIELDS = ["username", "email", "first_name", "last_name", "active", "roles"]


class Patched(NamedTuple):
    """Full rows of changed users, role links (user_id, role_id) of users with new roles, and refused requests."""

    users: DataFrame
    user_roles: DataFrame
    rejected: DataFrame


def patch_users(users: DataFrame, roles: DataFrame, patches: DataFrame) -> Patched:
    """Partial updates.

    ``patches``: request_id, username, new_username, new_email, new_first_name, new_last_name, new_active, new_roles
    (array), update_mask (comma-separated). Null means the field was not sent; a mask limits the update to its fields.
    Checked in this order: unknown user (404), username or address taken (409), mask names a field that was not sent
    (400), unknown role (400). Of several requests for one user, or for one new name or address, the smallest
    request_id goes first and the others are refused with 409.
    """
    current = users.selectExpr("username", "id AS user_id", "email AS old_email")
    p = patches.join(current, "username", "left").selectExpr(
        "*",
        "CASE WHEN new_username <> username THEN nullif(new_username, '') END AS wants_name",
        "CASE WHEN old_email IS NULL OR new_email <> old_email THEN nullif(new_email, '') END AS wants_email",
    )
    claims = p.selectExpr(
        "request_id",
        """inline(filter(array(named_struct('kind', 'user', 'key', username), named_struct('kind', 'name', 'key', wants_name),
            named_struct('kind', 'email', 'key', wants_email)), c -> c.key IS NOT NULL))""",
    )
    held = users.selectExpr(
        "inline(array(named_struct('kind', 'name', 'key', username), named_struct('kind', 'email', 'key', email)))"
    ).where("key IS NOT NULL")
    # one row for each thing claimed: who asks first, and whether a user has it already
    things = (
        claims.unionByName(held.select(F.lit(None).cast(claims.schema["request_id"].dataType).alias("request_id"), "kind", "key"))
        .groupBy("kind", "key")
        .agg(F.min("request_id").alias("first"), F.expr("bool_or(request_id IS NULL)").alias("taken"))
        .where("first IS NOT NULL")
    )
    # one name or address may be wanted by many requests, so this join is split by request
    outcome = salted_join(claims, things, ["kind", "key"], ["request_id"]).groupBy("request_id")
    p = p.join(
        outcome.agg(
            F.expr("bool_or(kind = 'name' AND taken)").alias("name_taken"),
            F.expr("bool_or(kind = 'email' AND taken)").alias("email_taken"),
            *[F.expr(f"bool_or(kind = '{k}' AND request_id > first)").alias(f"later_{k}") for k in ("user", "name", "email")],
        ),
        "request_id",
        "left",
    )

    mask = r"transform(split(nullif(update_mask, ''), ','), f -> btrim(f, ' \t\r\n'))"
    sent = ", ".join(f"CASE WHEN new_{f} IS NOT NULL THEN '{f}' END" for f in PATCH_FIELDS)
    p = p.selectExpr("*", f"{mask} AS mask", f"array_compact(array({sent})) AS sent").selectExpr(
        "*",
        "array_except(mask, sent) AS unsent",
        f"CASE WHEN {_is_masked_in('roles')} THEN new_roles END AS granted",
    )

    unknown = (
        salted_join(
            p.selectExpr("request_id", "explode(granted) AS name"), roles.select("name"), ["name"], ["request_id"], "left_anti"
        )
        .groupBy("request_id")
        .agg(F.expr("array_join(array_sort(collect_set(name)), ', ') AS unknown_roles"))
    )
    judged = p.join(unknown, "request_id", "left").selectExpr(
        "*",
        """CASE
        WHEN user_id IS NULL THEN named_struct('code', 404, 'detail', concat('no user ', username))
        WHEN name_taken OR later_name
            THEN named_struct('code', 409, 'detail', concat('username taken: ', wants_name))
        WHEN email_taken OR later_email
            THEN named_struct('code', 409, 'detail', concat('email taken: ', wants_email))
        WHEN later_user THEN named_struct('code', 409, 'detail', concat('already patched: ', username))
        WHEN size(unsent) > 0 THEN named_struct('code', 400, 'detail', concat('not sent: ', array_join(unsent, ', ')))
        WHEN unknown_roles IS NOT NULL
            THEN named_struct('code', 400, 'detail', concat('unknown roles: ', unknown_roles)) END AS refusal""",
    )
    accepted = judged.where("refusal IS NULL")

    plain = [f for f in PATCH_FIELDS if f != "roles"]
    news = accepted.selectExpr(
        "user_id AS id", *[f"CASE WHEN {_is_masked_in(f)} THEN new_{f} END AS _new_{f}" for f in plain]
    )
    kept = [f"coalesce(_new_{c}, {c}) AS {c}" if c in plain else c for c in users.columns]
    links = salted_join(
        accepted.selectExpr("user_id", "explode(granted) AS name"), roles.selectExpr("name", "id AS role_id"), ["name"], ["user_id"]
    )
    return Patched(
        users.join(news, "id").selectExpr(*kept),
        links.select("user_id", "role_id").distinct(),
        judged.where("refusal IS NOT NULL").selectExpr("request_id", "username", "refusal.code", "refusal.detail"),
    )


def _is_masked_in(name: str) -> str:
    return f"(mask IS NULL OR array_contains(mask, '{name}'))"
