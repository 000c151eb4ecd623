"""Credits, model-call cost and call budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pactframe.operators.asof import asof_lookup, following
from pactframe.operators.tenancy import by_account, in_scope
from pactframe.sources.tables import stored

# Price of a million tokens, and credits for each kind of use.
USD_PER_MILLION_IN = 3
USD_PER_MILLION_OUT = 15
ANALYSIS_CREDITS = 10
QUESTION_CREDITS = 2


def period_spend(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Credits booked per account since its billing period began.

    The ledger is summed by account and hour first, which map tasks reduce, so
    a busy account is one row per hour when it meets its period start.  Only
    the hour in which a period begins is then read row by row.
    """
    starts = by_account(accounts).select("account_id", "period_started_at").filter(F.col("period_started_at").isNotNull())
    hour = F.date_trunc("hour", "created_at")
    # the first hours of all periods; a row of such an hour keeps its own time
    first = starts.select("account_id", F.date_trunc("hour", "period_started_at").alias("hour"), "period_started_at")
    sums = ledger.groupBy("account_id", hour.alias("hour")).agg(F.sum("credits").alias("credits"))
    whole = sums.join(starts, "account_id").filter(F.col("hour") > F.date_trunc("hour", "period_started_at")).select("account_id", "credits")
    edge = (
        ledger.select("account_id", hour.alias("hour"), "credits", "created_at").groupBy("account_id", "hour", "created_at")
        .agg(F.sum("credits").alias("credits")).join(first, ["account_id", "hour"])
        .filter(F.col("created_at") >= F.col("period_started_at")).select("account_id", "credits")
    )
    return whole.unionByName(edge).groupBy("account_id").agg(F.sum("credits").alias("spent"))


def credits_remaining(accounts: DataFrame, ledger: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """max(0, included + banked - spend of the current period) per account."""
    owned = in_scope(by_account(accounts), scope)
    spend = period_spend(owned, in_scope(ledger, scope))
    allowance = F.coalesce("credits_included", F.lit(0)) + F.coalesce("credits_banked", F.lit(0))
    left = F.greatest(F.lit(0), allowance - F.coalesce("spent", F.lit(0)))
    return owned.join(spend, "account_id", "left").select("account_id", left.cast("int").alias("remaining"))


def credit_usage(ledger: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Spend and top-ups by account, kind and month, with subtotals."""
    rows = in_scope(ledger, scope).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return rows.rollup("account_id", "kind", "month").agg(
        F.sum(F.when(F.col("credits") > 0, F.col("credits")).otherwise(0)).alias("spent"),
        F.sum(F.when(F.col("credits") < 0, -F.col("credits")).otherwise(0)).alias("topped_up"),
        F.count(F.lit(1)).alias("entries"),
        F.grouping_id().alias("level"),
    )


def call_usd(tokens_in, tokens_out):
    """Price of a call, or of summed calls, in dollars; missing counts are 0."""
    cost = F.coalesce(tokens_in, F.lit(0)) * USD_PER_MILLION_IN + F.coalesce(tokens_out, F.lit(0)) * USD_PER_MILLION_OUT
    return cost / F.lit(1e6)


def token_cost(telemetry: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Tokens and cost per account and operation."""
    sums = (
        in_scope(telemetry, scope)
        .groupBy("account_id", "op")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
            F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        )
    )
    return sums.withColumn("usd", call_usd(F.col("tokens_in"), F.col("tokens_out")))


def hourly_call_budget(calls: DataFrame, cap: int = 60, scope: DataFrame | None = None) -> DataFrame:
    """Calls per account and clock hour, and how many go beyond the cap."""
    per_hour = (
        in_scope(calls, scope)
        .groupBy("account_id", F.date_trunc("hour", "created_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("calls"))
    )
    return per_hour.select(
        "*",
        F.least(F.col("calls"), F.lit(cap)).alias("allowed"),
        F.greatest(F.col("calls") - cap, F.lit(0)).alias("refused"),
    )


def anchored_windows(calls: DataFrame, length: str = "1 hour", scope: DataFrame | None = None) -> DataFrame:
    """Windows that begin with a call: (account_id, window_start, calls, first_call, last_call).

    A call more than ``length`` after the start of its account's window opens
    the next one, so where a window begins depends on all before it.  Each
    instant points to the first one that would open the next window; the
    starts are those that the first instant reaches.  Pointers are doubled: in
    each round the known starts are followed by as many steps as lie behind
    them, so the number of rounds is the logarithm of the windows of an account,
    and no account is walked through in one task.

    Equal instants are one place with a count.  Calls without a time or account
    are left out.
    """
    on = "account_id"
    places = in_scope(calls, scope).filter(F.col(on).isNotNull() & F.col("created_at").isNotNull()).groupBy(on, "created_at").agg(F.count(F.lit(1)).alias("n"))
    places = stored(places, "call-instants")
    marks = places.select(on, F.col("created_at").alias("at"))
    # the newest place not later than the end of a window; the one behind it opens the next
    ends = marks.select(on, (F.col("at") + F.expr(f"interval {length}")).alias("end"), "at")
    inside = asof_lookup(ends, marks.withColumn("_place", F.col("at")), [on], "end", "at", ["_place"], "hour").select(on, "end", "_place")
    after = following(marks, marks, [on], "at")
    jump = ends.join(inside, [on, "end"]).join(after.select(on, F.col("at").alias("_place"), "next"), [on, "_place"])
    jump = stored(jump.filter("next is not null").select(on, "at", F.col("next").alias("to")), "window-jumps")

    starts = stored(marks.groupBy(on).agg(F.min("at").alias("at")), "window-starts")
    count = starts.count()
    while True:
        grown = starts.unionByName(starts.join(jump, [on, "at"]).select(on, F.col("to").alias("at"))).distinct()
        grown = stored(grown, "window-starts")
        now = grown.count()
        if now == count:
            break
        starts, count = grown, now
        twice = jump.select(on, "at", F.col("to").alias("_mid")).join(jump.select(on, F.col("at").alias("_mid"), "to"), [on, "_mid"])
        jump = stored(twice.select(on, "at", "to"), "window-jumps")
    window = asof_lookup(marks, starts.withColumn("window_start", F.col("at")).withColumnRenamed("at", "_start"), [on], "at", "_start", ["window_start"], "hour")
    return places.join(window.withColumnRenamed("at", "created_at"), [on, "created_at"]).groupBy(on, "window_start").agg(
        F.sum("n").alias("calls"), F.min("created_at").alias("first_call"), F.max("created_at").alias("last_call"))


def anchored_call_budget(calls: DataFrame, cap: int = 60, length: str = "1 hour", scope: DataFrame | None = None) -> DataFrame:
    """Calls per account and window that begins with its first call, and how many go beyond the cap."""
    return anchored_windows(calls, length, scope).select(
        "account_id", "window_start", "calls", F.least(F.col("calls"), F.lit(cap)).alias("allowed"), F.greatest(F.col("calls") - cap, F.lit(0)).alias("refused"))


def roll_billing_period(
    accounts: DataFrame, ledger: DataFrame, plans: DataFrame, new_start, scope: DataFrame | None = None
) -> DataFrame:
    """Next period of each account: unused credits are banked up to the plan's cap.

    ``plans`` has (plan, bank_cap); a plan without a cap banks nothing.
    """
    owned = in_scope(by_account(accounts), scope)
    caps = plans.select("plan", "bank_cap")
    banked = F.least(F.coalesce("bank_cap", F.lit(0)), F.col("remaining"))
    return (
        owned.join(credits_remaining(owned, ledger), "account_id")
        .join(caps, "plan", "left")
        .select(
            "account_id",
            "plan",
            "credits_included",
            F.lit(0).alias("credits_used"),
            banked.cast("int").alias("credits_banked"),
            new_start.alias("period_started_at"),
        )
    )


def credit_preview(
    selection: DataFrame, accounts: DataFrame, ledger: DataFrame, scope: DataFrame | None = None
) -> DataFrame:
    """Cost of analysing a selection next to what each account has left.

    ``selection`` has (account_id, questions): one row per contract to analyse
    with the questions to ask about it.
    """
    cost = (
        in_scope(selection, scope)
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("contracts"), F.sum(F.coalesce("questions", F.lit(0))).alias("questions"))
        .withColumn("cost", F.col("contracts") * ANALYSIS_CREDITS + F.col("questions") * QUESTION_CREDITS)
    )
    left = credits_remaining(accounts, ledger, scope)
    return cost.join(left, "account_id", "left").select(
        "account_id",
        "contracts",
        "questions",
        "cost",
        F.coalesce("remaining", F.lit(0)).alias("remaining"),
        (F.coalesce("remaining", F.lit(0)) >= F.col("cost")).alias("affordable"),
    )
