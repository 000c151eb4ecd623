"""Who may see or change which rows, for one user or for a whole table of requests.

Scopes are semi-joins.  Whether the account side is broadcast is left to the
planner, which checks its size at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EDITOR_ROLES = ("owner", "admin", "member")
ADMIN_ROLES = ("owner", "admin")


def by_account(accounts: DataFrame) -> DataFrame:
    """Accounts with their id named like the column that refers to it."""
    return accounts if "account_id" in accounts.columns else accounts.withColumnRenamed("id", "account_id")


def my_accounts(members: DataFrame, user_id) -> DataFrame:
    """Accounts a user belongs to."""
    return members.filter(F.col("user_id") == F.lit(user_id)).select("account_id").distinct()


def own_memberships(members: DataFrame, user_id) -> DataFrame:
    return members.filter(F.col("user_id") == F.lit(user_id))


def in_scope(rows: DataFrame, accounts: DataFrame | None, key: str = "account_id") -> DataFrame:
    """Rows of the given accounts; every row when there is no scope."""
    if accounts is None:
        return rows
    allowed = accounts.select(F.col("account_id").alias(key)).distinct()
    return rows.join(allowed, key, "left_semi")


def own_or_global(packs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Packs of the given accounts plus the packs that have no account.

    A NULL account joins the scope as a value, which keeps this a hash join; an
    OR in the condition would make it a nested loop.
    """
    wanted = accounts.select(F.col("account_id").alias("_scope")).distinct()
    no_account = wanted.sparkSession.range(1).select(F.lit(None).cast(wanted.schema[0].dataType).alias("_scope"))
    return packs.join(
        wanted.unionByName(no_account), packs["account_id"].eqNullSafe(F.col("_scope")), "left_semi"
    )


def visible_profiles(members: DataFrame, profiles: DataFrame, user_id) -> DataFrame:
    """The user's own profile and those of everybody who shares an account."""
    colleagues = in_scope(members, my_accounts(members, user_id)).select(F.col("user_id").alias("id"))
    self_row = members.sparkSession.range(1).select(
        F.lit(user_id).cast(members.schema["user_id"].dataType).alias("id")
    )
    return profiles.join(colleagues.unionByName(self_row).distinct(), "id", "left_semi")


def member_role(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Adds the role a requesting user has in the requested account, or NULL."""
    roles = members.select("user_id", "account_id", "role")
    return requests.join(roles, ["user_id", "account_id"], "left")


def member_permissions(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Adds role, can_edit and can_admin; no membership means false, not NULL."""
    return member_role(requests, members).select(
        "*",
        F.coalesce(F.col("role").isin(*EDITOR_ROLES), F.lit(False)).alias("can_edit"),
        F.coalesce(F.col("role").isin(*ADMIN_ROLES), F.lit(False)).alias("can_admin"),
    )


def contract_access_decisions(actions: DataFrame, contracts: DataFrame, members: DataFrame) -> DataFrame:
    """Whether each requested (user, contract, action) is allowed.

    Any member may read, editors may insert and update, admins may delete.
    Unknown contracts and unknown actions are refused.
    """
    owners = contracts.select(F.col("id").alias("contract_id"), "account_id")
    asked = member_permissions(actions.join(owners, "contract_id", "left"), members)
    allowed = (
        F.when(F.col("action") == "read", F.col("role").isNotNull())
        .when(F.col("action").isin("insert", "update"), F.col("can_edit"))
        .when(F.col("action") == "delete", F.col("can_admin"))
        .otherwise(F.lit(False))
    )
    return asked.select(*actions.columns, "account_id", "role", allowed.alias("allowed"))


def admin_invitations(invitations: DataFrame, members: DataFrame, user_id) -> DataFrame:
    """Invitations of the accounts the user administers."""
    administered = members.filter(F.col("role").isin(*ADMIN_ROLES))
    return in_scope(invitations, my_accounts(administered, user_id))


def visible_contract_counts(members: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts and accounts each user can see.

    Contracts are counted per account before the join, so an account with many
    contracts and many members never multiplies into their product.
    """
    per_account = contracts.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    seats = members.select("user_id", "account_id").distinct()
    return (
        seats.join(per_account, "account_id", "left")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("accounts"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("contracts"),
        )
    )
