"""Policy pack and obligation queries."""

from pyspark.sql import functions as F

from pactframe.operators import obligations, policy
from pactframe.plans.registry import register
from pactframe.plans.times import OBLIGATIONS_AS_OF

AT = "1998-06-30 12:00:00"


@register(
    "obligations_due",
    f"""select t.id, t.contract_id, t.obligation_ix, t.party, t.assignee_id, t.due_date, t.status, t.obligation, t.completed_by, c.ref, c.supplier,
      t.due_date < date '{OBLIGATIONS_AS_OF}' as overdue, t.assignee_id is null as unassigned
    from dom_obligations_raw t join dom_contracts c on c.id = t.contract_id where t.status = 'open'""",
)
def obligations_due(t):
    return obligations.obligations_due(t("dom_obligations_raw"), t("dom_contracts"), OBLIGATIONS_AS_OF)


@register(
    "policy_packs_at",
    f"""select id, account_id, pack_key, updated_by, jurisdiction, effective_from, effective_to from dom_policy_packs
    where active and effective_from <= timestamp '{AT}' and (effective_to is null or effective_to > timestamp '{AT}')
      and jurisdiction in ('GB', 'ANY')""",
)
def policy_packs_at(t):
    packs = t("dom_policy_packs").drop("rules", "version")
    return policy.policy_packs_at(packs, AT, "GB").drop("active")


@register(
    "policy_rules",
    """select id, pack_key, version, cast(i as integer) as rule_ix, json_extract_string(rules, '$[' || i || ']') as rule
    from dom_policy_packs, range(0, 2) r(i) where i < json_array_length(rules)""",
)
def policy_rules(t):
    return policy.policy_rules(t("dom_policy_packs").select("id", "pack_key", "version", "rules"))


GRADED = """graded as (select id as contract_id, account_id, case account_id % 4 when 0 then 'GB' when 1 then 'EU' when 2 then 'US' else 'CH' end as jurisdiction,
      cast(start_date as timestamp) as graded_at from dom_contracts)"""


@register(
    "analysis_policy_snapshot",
    f"""with {GRADED}
    select g.contract_id, g.account_id, g.jurisdiction, g.graded_at,
      count(p.id) filter (where p.account_id is null) as global_packs,
      count(p.id) filter (where p.account_id is not null) as own_packs,
      cast(coalesce(sum(('0x' || substr(md5(cast(p.id as varchar)), 1, 9))::bigint), 0) as bigint) as pack_set
    from graded g left join dom_policy_packs p on p.jurisdiction in (g.jurisdiction, 'ANY')
      and (p.account_id is null or p.account_id = g.account_id)
      and p.active and p.effective_from <= g.graded_at and (p.effective_to is null or p.effective_to > g.graded_at)
    group by all""",
)
def analysis_policy_snapshot(t):
    return policy.policy_snapshot(graded(t), t("dom_policy_packs"), "graded_at")


def graded(t):
    region = F.when(F.col("account_id") % 4 == 0, "GB").when(F.col("account_id") % 4 == 1, "EU").when(F.col("account_id") % 4 == 2, "US").otherwise("CH")
    return t("dom_contracts").select(
        F.col("id").alias("contract_id"),
        "account_id",
        region.alias("jurisdiction"),
        F.col("start_date").cast("timestamp").alias("graded_at"),
    )


# Every pair of analysis and pack in force, and the sets they form; what the two queries below are checked with.
BRIDGE = f"""{GRADED},
  asked as (select distinct account_id, jurisdiction, graded_at from graded),
  pairs as (select a.*, p.id as pack_id, p.account_id is null as is_global, p.jurisdiction as place
    from asked a join dom_policy_packs p on p.jurisdiction in (a.jurisdiction, 'ANY') and (p.account_id is null or p.account_id = a.account_id)
      and p.active and p.effective_from <= a.graded_at and (p.effective_to is null or p.effective_to > a.graded_at)),
  named as (select *, count(*) over s || ':' || sum(('0x' || substr(md5(cast(pack_id as varchar)), 1, 9))::bigint) over s || ':'
      || sum(('0x' || substr(md5(cast(pack_id as varchar)), 10, 9))::bigint) over s as set_id
    from pairs window s as (partition by account_id, jurisdiction, graded_at, is_global, place))"""


@register("analysis_pack_sets", f"with {BRIDGE} select distinct account_id, jurisdiction, graded_at, set_id from named")
def analysis_pack_sets(t):
    return policy.analysis_pack_sets(graded(t), t("dom_policy_packs"), "graded_at")


@register("pack_sets", f"with {BRIDGE} select distinct set_id, pack_id from named")
def pack_sets(t):
    """The dictionary of the pack sets that graded an analysis."""
    packs = t("dom_policy_packs")
    return policy.pack_sets(packs, policy.used_pack_sets(graded(t), packs, "graded_at"))
