"""Sign-up, invitation and membership queries."""

from pyspark.sql import functions as F

from pactframe.operators import accounts
from pactframe.plans.registry import register
from pactframe.plans.times import AS_OF

# Capital after every character that is not a letter or digit, without initcap.
TITLE = """array_to_string(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+|[^a-zA-Z0-9]+'),
      lambda w: upper(w[1]) || lower(w[2:])), '')"""
DOMAIN = "split_part(split_part(email, '@', 2), '.', 1)"

OUTCOMES = """tried as (select a.id, a.user_id, a.email, a.token, a.ts, i.email as invited, i.account_id, i.role,
      i.token is not null and i.accepted_at is null and i.expires_at > a.ts as open_offer
    from dom_accept_attempts a left join dom_invitations i on i.token = a.token),
  judged as (select *, user_id is not null and open_offer and lower(invited) = lower(email) as passes from tried),
  winners as (select token, min((ts, id)) as won from judged where passes group by token),
  outcomes as (select j.*, case when user_id is null then 'not signed in'
      when not open_offer then 'invitation not found or expired'
      when (ts, id) = won then 'accepted'
      when (ts, id) > won then 'invitation not found or expired'
      when not passes then 'this invitation was sent to ' || invited end as outcome
    from judged j left join winners w on w.token = j.token)"""


@register(
    "plan_catalog",
    """select p.plan, p.title, p.credits, p.period_days, p.monthly_price, p.bank_cap, count(a.account_id) as accounts
    from (values ('sandbox', 'Evaluation Sandbox', 150, 90, 0, 0), ('growth', 'Growth / Professional', 500, 30, 79, 300),
      ('scale', 'Scale', 1800, 30, 199, 1800), ('enterprise', 'Enterprise Suite', 5000, 30, null, 0))
      p(plan, title, credits, period_days, monthly_price, bank_cap)
    left join dom_accounts a on a.plan = p.plan group by all""",
)
def plan_catalog(t):
    used = t("dom_accounts").groupBy("plan").agg(F.count(F.lit(1)).alias("accounts"))
    return accounts.plan_catalog(t.spark).join(used, "plan", "left").fillna(0, ["accounts"])


@register(
    "signup_checks",
    """select id, case when trim(first_name) = '' or trim(last_name) = '' or trim(company) = '' then 'Please complete your name and company.'
      when not regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 'Please enter a valid work email address.'
      when not terms then 'Please accept the Terms and Privacy Policy to continue.' end as reject_reason from dom_signups""",
)
def signup_checks(t):
    return accounts.signup_checks(t("dom_signups")).select("id", "reject_reason")


@register(
    "signup_routing",
    """select id, plan, e as effective_plan, case e when 'enterprise' then 'sales' when 'sandbox' then 'workspace' else 'payment' end as route,
      e <> 'sandbox' as asks_vat
    from (select *, case when plan in ('sandbox', 'growth', 'scale', 'enterprise') then plan else 'growth' end as e from dom_signups) x""",
)
def signup_routing(t):
    return accounts.signup_routing(t("dom_signups").select("id", "plan"))


@register(
    "provision_accounts",
    f"""select u.id, u.email, u.id not in (select id from dom_profiles) as profile_made,
      case when u.id not in (select id from dom_profiles) then coalesce(json_extract_string(meta, '$.full_name'),
        json_extract_string(meta, '$.name'), split_part(email, '@', 1)) end as full_name,
      coalesce(json_extract_string(meta, '$.company'), {TITLE.format(DOMAIN)}) as org_name,
      'sandbox' as plan, 150 as credits_included, 'owner' as role
    from dom_new_users u""",
)
def provision_accounts(t):
    made, spaces, members = accounts.provision_accounts(t("dom_new_users"), t("dom_profiles"))
    return (
        members.join(spaces, "account_id")
        .join(made.select(F.col("id").alias("user_id"), "full_name", F.lit(True).alias("_made")), "user_id", "left")
        .select(
            F.col("user_id").alias("id"),
            F.col("billing_email").alias("email"),
            F.coalesce("_made", F.lit(False)).alias("profile_made"),
            "full_name",
            F.col("name").alias("org_name"),
            "plan",
            "credits_included",
            "role",
        )
    )


@register(
    "live_invitations",
    f"""select id, account_id, invited_by, email, role, token, expires_at, accepted_at, lower(email) as email_key from dom_invitations
    where accepted_at is null and expires_at > timestamp '{AS_OF}'""",
)
def live_invitations(t):
    return accounts.live_invitations(t("dom_invitations"), AS_OF)


@register(
    "invitation_outcomes",
    f"""with {OUTCOMES}
    select id, user_id, email, token, ts, outcome, case when outcome = 'accepted' then account_id end as account_id,
      case when outcome = 'accepted' then role end as role from outcomes""",
)
def invitation_outcomes(t):
    return accounts.invitation_outcomes(t("dom_accept_attempts"), t("dom_invitations"))


@register(
    "upsert_members",
    f"""with {OUTCOMES},
    won as (select user_id, account_id, role from (select *, row_number() over (partition by user_id, account_id order by ts desc, id desc) as rn
      from outcomes where outcome = 'accepted') x where rn = 1)
    select user_id, account_id, role from won
    union all
    select user_id, account_id, role from dom_members m
    where not exists (select 1 from won w where w.user_id = m.user_id and w.account_id = m.account_id)""",
)
def upsert_members(t):
    outcomes = accounts.invitation_outcomes(t("dom_accept_attempts"), t("dom_invitations"))
    return accounts.upsert_members(t("dom_members"), outcomes)


@register(
    "terms_acceptance",
    """with newest as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id % 3 desc) as rn
      from events where event_type = 'signup') x where rn = 1)
    select p.id, p.email, p.full_name, n.ts as terms_accepted_at, '2026.' || cast(n.event_id % 3 as varchar) as terms_version
    from dom_profiles p left join newest n on n.user_id = p.id""",
)
def terms_acceptance(t):
    accepted = (
        t.base("events")
        .filter("event_type = 'signup'")
        .select("user_id", F.col("ts").alias("accepted_at"), F.concat(F.lit("2026."), (F.col("event_id") % 3).cast("string")).alias("version"))
    )
    return accounts.terms_acceptance(t("dom_profiles"), accepted)
