"""Sign-in upsert: external identities into the user table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.functions.text import clean, norm_email, short_id
from recordflow.operators.change import _lit, assign_ids, insert_rows, starter_rows
from recordflow.operators.join import left_unique, match_priority
from recordflow.session import materialize

# Names of users whose profile has none, and the provider they come from.
FIRST_NAME, LAST_NAME, PROVIDER = "Google", "User", "google"
DISABLED = ("blocked", "revoked")


def _last(column: str, order: list[str], where=None):
    at = F.struct(*order)
    return F.max_by(column, at if where is None else F.when(where, at)).alias(column)


def _collapse(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first address, the last other values, and the last non-empty names."""
    first = [] if key == "email" else [F.min_by("email", F.struct(*order)).alias("email")]
    return df.groupBy(key).agg(
        *first, *[_last(c, order) for c in ("sub", "picture", *order) if c != key],
        _last("given_name", order, F.col("given_name") != ""),
        _last("family_name", order, F.col("family_name") != ""))


def upsert_users(users: DataFrame, src: DataFrame, order: list[str], now,
                 start_id: int) -> tuple[DataFrame, DataFrame]:
    """(user table, rejected source rows with ``reason``).

    Source rows hold sub, email, email_verified, given_name, family_name, picture. A row needs
    a subject and a verified address; it meets a user by subject, else by address. Users that
    are blocked, revoked or refunded are not touched. Rows of one batch meet the table as it
    was before; those that reach one user collapse to the last row, empty names keeping the
    earlier ones and the address being the first. New users get the keys after ``start_id``, in order of the first order column,
    a unique integer.
    """
    cleaned = src.withColumns({
        "sub": clean("sub"), "email": F.coalesce(norm_email("email"), F.lit("")),
        "given_name": clean("given_name"), "family_name": clean("family_name"),
        "picture": F.nullif(clean("picture"), F.lit(""))})
    reason = (F.when((F.col("sub") == "") | (F.col("email") == ""), "incomplete")
              .when(~F.coalesce("email_verified", F.lit(False)), "not_verified"))
    checked = cleaned.withColumn("reason", reason)
    matched = match_priority(checked.filter("reason is null"), users,
                             [("sub", "google_sub"), ("email", "email")], "id", "user_id")
    status = users.select(F.col("id").alias("user_id"), F.col("account_status").alias("_status"))
    matched = left_unique(matched, status, [("user_id", "user_id")], ["_status"]).withColumn(
        "reason", F.when(F.col("_status").isin(*DISABLED), "disabled")
        .when(F.col("_status") == "refunded", "refunded"))
    rejects = checked.filter("reason is not null").unionByName(
        matched.filter("reason is not null").select(*checked.columns))
    allowed = matched.filter("reason is null").drop("_status", "reason")

    known = _collapse(allowed.filter("user_id is not null"), "user_id", order)
    side = known.select(F.col("user_id").alias("id"), F.lit(True).alias("_hit"), "sub", "picture",
                        "given_name", "family_name")
    hit = F.col("_hit").isNotNull()
    values = {
        "first_name": F.coalesce("given_name", F.col("first_name")),
        "last_name": F.coalesce("family_name", F.col("last_name")),
        "auth_provider": F.when(hit, F.lit(PROVIDER)).otherwise(F.col("auth_provider")),
        "google_sub": F.when(hit, F.col("sub")).otherwise(F.col("google_sub")),
        "google_picture_url": F.when(hit, F.col("picture")).otherwise(
            F.col("google_picture_url")),
        "email_verified": F.when(hit, F.lit(True)).otherwise(F.col("email_verified")),
        "last_login_at": F.when(hit, _lit(now, "timestamp_ntz")).otherwise(
            F.col("last_login_at")),
    }
    updated = users.join(side, "id", "left").select(
        *[values[c].alias(c) if c in values else F.col(c) for c in users.columns])

    by_sub = _collapse(allowed.filter("user_id is null"), "sub", order)
    fresh = _collapse(by_sub, "email", order)
    place = order[0]
    new = fresh.select(
        F.col(place).alias("_order"),
        F.coalesce("given_name", F.lit(FIRST_NAME)).alias("first_name"),
        F.coalesce("family_name", F.lit(LAST_NAME)).alias("last_name"), "email",
        F.lit("active").alias("account_status"), F.lit(PROVIDER).alias("auth_provider"),
        F.col("sub").alias("google_sub"), F.col("picture").alias("google_picture_url"),
        F.lit(True).alias("email_verified"), _lit(now, "timestamp_ntz").alias("last_login_at"),
        short_id(32, "email", "sub").alias("uuid"))
    new = assign_ids(new, "_order", start_id).drop("_order")
    return insert_rows(updated, new, now=now), rejects


def sign_in(users: DataFrame, projects: DataFrame, src: DataFrame, order: list[str], now,
            start_user: int, start_project: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, projects, rejected): sign-ins as in :func:`upsert_users`; then each user whose last
    login is ``now`` and who never had a project, active or not, gets a starter project."""
    after, rejected = upsert_users(users, src, order, now, start_user)
    here = materialize(after.filter(F.col("last_login_at") == _lit(now, "timestamp_ntz"))
                       .select("id"), "signed-in")
    fresh, _ = starter_rows(here, "id", projects, active_only=False)
    fresh = fresh.drop("description").withColumn("last_opened_on", _lit(now, "timestamp_ntz"))
    new = assign_ids(fresh, "owner_id", start_project)
    kept = [c for c in new.columns if c in projects.columns]
    return after, insert_rows(projects, new.select(*kept), now=now), rejected
