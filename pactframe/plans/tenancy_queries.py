"""Tenant scope and permission queries."""

from pyspark.sql import functions as F

from pactframe.operators import tenancy
from pactframe.plans.registry import register

USER = 11


@register("my_accounts", f"select distinct account_id from dom_members where user_id = {USER}")
def my_accounts(t):
    return tenancy.my_accounts(t("dom_members"), USER)


@register("own_memberships", f"select user_id, account_id, role from dom_members where user_id = {USER}")
def own_memberships(t):
    return tenancy.own_memberships(t("dom_members"), USER)


@register(
    "tenant_contracts",
    f"""select id, account_id, supplier, annual_value::double as annual_value, end_date from dom_contracts
    where account_id in (select account_id from dom_members where user_id = {USER})""",
)
def tenant_contracts(t):
    scope = tenancy.my_accounts(t("dom_members"), USER)
    return tenancy.in_scope(t("dom_contracts"), scope).select("id", "account_id", "supplier", "annual_value", "end_date")


@register(
    "tenant_documents",
    f"""select d.id, c.account_id, d.name, d.size_bytes from dom_documents d join dom_contracts c on c.id = d.contract_id
    where c.account_id in (select account_id from dom_members where user_id = {USER})""",
)
def tenant_documents(t):
    owned = tenancy.in_scope(
        t("dom_contracts").select(F.col("id").alias("contract_id"), "account_id"),
        tenancy.my_accounts(t("dom_members"), USER),
    )
    docs = t("dom_documents").select("id", "contract_id", "name", "size_bytes")
    return docs.join(owned, "contract_id").select("id", "account_id", "name", "size_bytes")


@register(
    "tenant_policy_packs",
    f"""select id, account_id, pack_key, version, jurisdiction from dom_policy_packs
    where account_id is null or account_id in (select account_id from dom_members where user_id = {USER})""",
)
def tenant_policy_packs(t):
    packs = t("dom_policy_packs").select("id", "account_id", "pack_key", "version", "jurisdiction")
    return tenancy.own_or_global(packs, tenancy.my_accounts(t("dom_members"), USER))


@register(
    "visible_profiles",
    f"""select id, email, full_name from dom_profiles where id = {USER} or id in (
      select user_id from dom_members where account_id in (select account_id from dom_members where user_id = {USER}))""",
)
def visible_profiles(t):
    return tenancy.visible_profiles(t("dom_members"), t("dom_profiles"), USER)


@register(
    "member_role",
    """select r.id, r.user_id, r.account_id, m.role from dom_enqueue_requests r
    left join dom_members m on m.user_id = r.user_id and m.account_id = r.account_id""",
)
def member_role(t):
    requests = t("dom_enqueue_requests").select("id", "user_id", "account_id")
    return tenancy.member_role(requests, t("dom_members")).select("id", "user_id", "account_id", "role")


@register(
    "member_permissions",
    """select q.id, q.user_id, q.account_id,
      coalesce(m.role in ('owner', 'admin', 'member'), false) as can_edit,
      coalesce(m.role in ('owner', 'admin'), false) as can_admin
    from dom_enqueue_requests q left join dom_members m on m.user_id = q.user_id and m.account_id = q.account_id""",
)
def member_permissions(t):
    requests = t("dom_enqueue_requests").select("id", "user_id", "account_id")
    return tenancy.member_permissions(requests, t("dom_members")).select(
        "id", "user_id", "account_id", "can_edit", "can_admin"
    )


@register(
    "contract_access_decisions",
    """select a.id, a.user_id, a.contract_id, a.action, c.account_id, m.role,
      case when a.action = 'read' then m.role is not null
           when a.action in ('insert', 'update') then coalesce(m.role in ('owner', 'admin', 'member'), false)
           when a.action = 'delete' then coalesce(m.role in ('owner', 'admin'), false)
           else false end as allowed
    from dom_contract_actions a left join dom_contracts c on c.id = a.contract_id
    left join dom_members m on m.user_id = a.user_id and m.account_id = c.account_id""",
)
def contract_access_decisions(t):
    contracts = t("dom_contracts").select("id", "account_id")
    return tenancy.contract_access_decisions(t("dom_contract_actions"), contracts, t("dom_members"))


@register(
    "admin_invitations",
    f"""select id, account_id, email, role from dom_invitations where account_id in
      (select account_id from dom_members where user_id = {USER - 1} and role in ('owner', 'admin'))""",
)
def admin_invitations(t):
    rows = t("dom_invitations").select("id", "account_id", "email", "role")
    return tenancy.admin_invitations(rows, t("dom_members"), USER - 1)


@register(
    "visible_contract_counts",
    """select m.user_id, count(distinct m.account_id) as accounts, count(c.id) as contracts
    from (select distinct user_id, account_id from dom_members) m
    left join dom_contracts c on c.account_id = m.account_id group by m.user_id""",
)
def visible_contract_counts(t):
    return tenancy.visible_contract_counts(t("dom_members"), t("dom_contracts").select("id", "account_id"))
