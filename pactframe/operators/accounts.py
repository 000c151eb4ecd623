"""Sign-up, invitations, memberships and the plan catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pactframe.functions.columns import instant, title_case
from pactframe.functions.spread import newest_per_key

FREE_PLAN = "sandbox"
FREE_CREDITS = 150
DEFAULT_PLAN = "growth"

# Plan, title, credits, days per period, monthly price in pounds
# (NULL = on request), and the cap up to which unused credits are banked.
PLANS = [
    ("sandbox", "Evaluation Sandbox", 150, 90, 0, 0),
    ("growth", "Growth / Professional", 500, 30, 79, 300),
    ("scale", "Scale", 1800, 30, 199, 1800),
    ("enterprise", "Enterprise Suite", 5000, 30, None, 0),
]
# Fixed value: what counts as a work e-mail address.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def plan_catalog(spark: SparkSession) -> DataFrame:
    """The plan dimension, four rows."""
    return spark.createDataFrame(
        PLANS, "plan string, title string, credits int, period_days int, monthly_price int, bank_cap int"
    )


def signup_checks(signups: DataFrame) -> DataFrame:
    """Adds the first reason to reject a sign-up, or NULL.

    ``signups`` has first_name, last_name, email, company and terms.
    """

    # fixed values: the messages
    def blank(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""

    reason = (
        F.when(blank("first_name") | blank("last_name") | blank("company"), "Please complete your name and company.")
        .when(~F.coalesce(F.trim("email"), F.lit("")).rlike(EMAIL), "Please enter a valid work email address.")
        .when(~F.coalesce("terms", F.lit(False)), "Please accept the Terms and Privacy Policy to continue.")
    )
    return signups.withColumn("reject_reason", reason)


def signup_routing(signups: DataFrame) -> DataFrame:
    """Adds the effective plan, where the sign-up goes, and whether a VAT number is asked for."""
    known = F.col("plan").isin(*[p[0] for p in PLANS])
    plan = F.when(known, F.col("plan")).otherwise(DEFAULT_PLAN)
    route = F.when(plan == "enterprise", "sales").when(plan == FREE_PLAN, "workspace").otherwise("payment")
    return signups.select("*", plan.alias("effective_plan"), route.alias("route"), (plan != FREE_PLAN).alias("asks_vat"))


def email_part(email: Column, part: int) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(part))


def provision_accounts(new_users: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, accounts and owner memberships for new users.

    ``new_users`` has id, email and meta (JSON text).  Existing profiles are
    left alone; the workspace is made in any case.  The account id is derived
    from the user id, so a rerun makes the same one.
    """

    def meta(name: str) -> Column:
        return F.get_json_object("meta", f"$.{name}")

    domain_label = F.split_part(email_part(F.col("email"), 2), F.lit("."), F.lit(1))
    users = new_users.select(
        "id",
        "email",
        F.coalesce(meta("full_name"), meta("name"), email_part(F.col("email"), 1)).alias("full_name"),
        F.coalesce(meta("company"), title_case(domain_label)).alias("org_name"),
        F.sha2(F.concat(F.lit("account:"), F.col("id").cast("string")), 256).alias("account_id"),
    )
    made = users.select("id", "email", "full_name").join(profiles.select("id"), "id", "left_anti")
    accounts = users.select(
        "account_id",
        F.col("org_name").alias("name"),
        F.lit(FREE_PLAN).alias("plan"),
        F.lit(FREE_CREDITS).alias("credits_included"),
        F.col("email").alias("billing_email"),
    )
    members = users.select(F.col("id").alias("user_id"), "account_id", F.lit("owner").alias("role"))
    return made, accounts, members


def live_invitations(invitations: DataFrame, as_of) -> DataFrame:
    """Neither accepted nor expired, with the address in lower case for lookups."""
    return invitations.filter(F.col("accepted_at").isNull() & (F.col("expires_at") > instant(as_of))).withColumn(
        "email_key", F.lower("email")
    )


def invitation_outcomes(attempts: DataFrame, invitations: DataFrame) -> DataFrame:
    """What each attempt to accept an invitation leads to.

    ``attempts`` has (id, user_id, email, token, ts).  The checks run in order:
    not signed in, unknown or expired or used, sent to another address.  Of the
    attempts that pass, the first per invitation is accepted and later ones find
    the invitation used.
    """
    invited = F.col("_invited")
    offers = invitations.select(
        "token", "account_id", "role", F.col("email").alias("_invited"), "expires_at", F.col("accepted_at").alias("_used")
    )
    # The winner is the earliest signed-in attempt from the invited address.  Attempts
    # are reduced to one per token and address first, and each attempt then meets its
    # invitation and the winner in a single join.
    earliest = (
        attempts.filter(F.col("user_id").isNotNull())
        .groupBy("token", F.lower("email").alias("_from"))
        .agg(F.min(F.struct("ts", "id")).alias("_first"))
    )
    winners = (
        offers.filter(F.col("_used").isNull())
        .withColumn("_from", F.lower("_invited"))
        .join(earliest, ["token", "_from"])
        .filter(F.col("expires_at") > F.col("_first.ts"))
        .select("token", "_first")
    )
    tried = attempts.join(offers.join(winners, "token", "left"), "token", "left")
    open_offer = invited.isNotNull() & F.col("_used").isNull() & (F.col("expires_at") > F.col("ts"))
    tried = tried.withColumn("_open", F.coalesce(open_offer, F.lit(False)))
    outcome = (
        F.when(F.col("user_id").isNull(), "not signed in")
        .when(~F.col("_open"), "invitation not found or expired")
        .when(F.col("_first.id") == F.col("id"), "accepted")
        # a later attempt, by anyone, meets a used invitation
        .when(F.col("_first").isNotNull() & (F.struct("ts", "id") > F.col("_first")), "invitation not found or expired")
        .otherwise(F.concat(F.lit("this invitation was sent to "), invited))
    )
    accepted = F.col("outcome") == "accepted"
    return tried.withColumn("outcome", outcome).select(
        *attempts.columns,
        "outcome",
        F.when(accepted, F.col("account_id")).alias("account_id"),
        F.when(accepted, F.col("role")).alias("role"),
    )


def upsert_members(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Memberships after accepted invitations; a new role replaces the old one."""
    old = members.select("user_id", "account_id", "role", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("id"))
    new = outcomes.filter(F.col("outcome") == "accepted").select("user_id", "account_id", "role", "ts", "id")
    # NULL sorts below any time, so accepted rows win over existing ones
    return newest_per_key(old.unionByName(new), ["user_id", "account_id"], ["ts", "id"]).select("user_id", "account_id", "role")


def terms_acceptance(profiles: DataFrame, acceptances: DataFrame) -> DataFrame:
    """Profiles with their newest acceptance; ``acceptances`` has (user_id, version, accepted_at)."""
    newest = newest_per_key(
        acceptances.select(F.col("user_id").alias("id"), "accepted_at", "version"), ["id"], ["accepted_at", "version"]
    )
    keep = [c for c in profiles.columns if c not in ("terms_accepted_at", "terms_version")]
    had = "terms_accepted_at" in profiles.columns
    old_at = F.col("_old_at") if had else F.lit(None).cast("timestamp")
    old_version = F.col("_old_version") if had else F.lit(None).cast("string")
    rows = profiles
    if had:
        rows = rows.withColumnRenamed("terms_accepted_at", "_old_at").withColumnRenamed("terms_version", "_old_version")
    return rows.join(newest, "id", "left").select(
        *keep,
        F.coalesce("accepted_at", old_at).alias("terms_accepted_at"),
        F.when(F.col("accepted_at").isNotNull(), F.col("version")).otherwise(old_version).alias("terms_version"),
    )
