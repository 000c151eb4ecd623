"""Domain tables derived from the test parquet.

One SQL text per table, written so that Spark and the SQL oracle read it
unchanged; ``{name}`` stands for a base table.
"""

BINDINGS = {
    "dom_accounts": r"""
select c_custkey as account_id, c_name as name,
  case c_custkey % 4 when 0 then 'sandbox' when 1 then 'growth' when 2 then 'scale' else 'enterprise' end as plan,
  cast(case c_custkey % 4 when 0 then 150 when 1 then 500 when 2 then 1800 else 5000 end as int) as credits_included,
  cast((c_custkey * 7) % 100 as int) as credits_banked,
  case when c_custkey % 17 = 0 then null else timestamp '2024-01-10 00:00:00' end as period_started_at,
  case when c_custkey % 4 = 0 then null else concat('cus_', cast(c_custkey - case when c_custkey % 31 = 2 then 1 else 0 end as string)) end as billing_customer_id
from {customer}
""",
    "dom_members": r"""
select c_custkey as user_id, c_custkey as account_id, 'owner' as role from {customer}
union all
select c_custkey, c_custkey - c_custkey % 10,
  case c_custkey % 3 when 0 then 'admin' when 1 then 'member' else 'viewer' end
from {customer} where c_custkey % 10 <> 0
""",
    "dom_contracts": r"""
select concat('c', cast(o_orderkey as string)) as id, o_custkey as account_id,
  concat('CTR-', cast(o_orderkey as string)) as ref, s_name as supplier, o_orderpriority as category,
  cast(o_totalprice as decimal(18,2)) as annual_value, cast(o_orderdate as date) as start_date,
  cast(o_orderdate as date) + cast(365 + o_orderkey % 1460 as int) as end_date,
  cast(case when o_orderkey % 13 = 0 then null else case o_orderkey % 4 when 0 then 30 when 1 then 60 when 2 then 90 else 180 end end as int) as notice_period_days,
  (o_orderkey % 2 = 0) as auto_renew, cast(o_orderkey % 9 as int) as users_count
from {orders} join {supplier} on s_suppkey = cast(floor(o_custkey / 15) as bigint)
""",
    "dom_credit_ledger": r"""
select event_id as id, user_id as account_id, case when event_id % 5 = 0 then null else user_id end as user_id,
  case event_type when 'signup' then 'topup' when 'click' then 'cedric' else 'analysis' end as kind,
  cast(case event_type when 'signup' then -50 when 'click' then 2 else 10 end as int) as credits, ts as created_at
from {events} where event_type <> 'error'
""",
    "dom_data_points": r"""
select concat('p', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
  concat('c', cast(l_orderkey as string)) as contract_id, l_partkey % 10 as marker,
  case when l_suppkey % 3 = 0 then null else l_orderkey * 4 end as analysis_id, case when l_suppkey % 4 = 0 then null else l_suppkey end as verified_by,
  concat('field', cast(l_suppkey % 12 as string)) as field,
  case l_linenumber % 4 when 0 then 'extraction' when 1 then 'clause' when 2 then 'risk' else 'obligation' end as kind,
  cast(floor(l_quantity * 2) as int) as confidence,
  case l_partkey % 4 when 0 then 'pending' when 1 then 'accepted' when 2 then 'corrected' else 'rejected' end as status,
  case when l_returnflag = 'R' then null else l_linestatus = 'O' end as was_correct, l_shipdate as created_at
from {lineitem}
""",
    "dom_verification_audit": r"""
select cast(event_id as string) as id,
  case when event_id % 29 = 0 or point_id is null then concat('x', cast(event_id as string)) else point_id end as data_point_id, user_id,
  case event_type when 'view' then 'accepted' when 'click' then 'corrected' when 'purchase' then 'rejected' else 'reopened' end as action,
  case when event_type = 'click' then concat('v', cast(event_id % 50 as string)) else null end as value_after, ts as created_at
from {events} left join (
  select l_orderkey, l_linenumber,
    min(concat('p', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string))) as point_id
  from {lineitem} group by l_orderkey, l_linenumber) lines
  on l_orderkey = event_id - event_id % 3 and l_linenumber = 1 + cast(floor(event_id / 3) as bigint) % 4
where event_type <> 'error'
""",
    "dom_analyses": r"""
select event_id as id, concat('c', cast(cast(floor(event_id / 4) as bigint) as string)) as contract_id, props as analysis, ts as created_at
from {events} where event_type in ('purchase', 'signup')
""",
    "dom_contract_actions": r"""
select event_id as id,
  case event_id % 3 when 0 then o_custkey when 1 then o_custkey - o_custkey % 10 + 1 + event_id % 9 else user_id end as user_id,
  concat('c', cast(o_orderkey as string)) as contract_id,
  case event_id % 4 when 0 then 'read' when 1 then 'insert' when 2 then 'update' else 'delete' end as action
from {events} join {orders} on o_orderkey = event_id + cast(floor(event_id / 2) as bigint)
""",
    "dom_answer_key": r"""
select concat('c', cast(o_orderkey as string)) as contract_id, concat('field', cast(o_orderkey % 12 as string)) as field,
  o_orderstatus as expected from {orders}
""",
    "dom_obligations_raw": r"""
select l_orderkey * 10 + l_linenumber as id, concat('c', cast(l_orderkey as string)) as contract_id, l_linenumber as obligation_ix,
  concat('The party will promise this, item ', cast(l_partkey as string)) as obligation,
  case when l_linenumber % 2 = 0 then 'us' else 'supplier' end as party,
  case when l_suppkey % 3 = 0 then null else l_suppkey end as assignee_id,
  case when l_returnflag = 'A' then l_suppkey else null end as completed_by,
  case when l_partkey % 9 = 0 then null else cast(l_shipdate as date) end as due_date,
  case when l_returnflag = 'A' then 'done' when l_returnflag = 'R' then 'waived' else 'open' end as status
from {lineitem}
""",
    "dom_jobs": r"""
select event_id as id, user_id as account_id, case when event_id % 9 = 0 then null else user_id end as requested_by,
  case when event_id % 40 = 7 then concat('x', cast(event_id as string)) else concat('c', cast(cast(floor(event_id / 6) as bigint) as string)) end as contract_id,
  case event_type when 'view' then 'ingest' when 'click' then 'ocr' when 'purchase' then 'analysis' when 'signup' then 'reanalysis' else 'export' end as kind,
  case event_id % 8 when 0 then 'queued' when 1 then 'queued' when 2 then 'running' when 3 then 'running' when 4 then 'dead' else 'succeeded' end as status,
  cast(case user_id % 4 when 3 then 10 when 2 then 30 when 1 then 50 else 100 end as int) as priority,
  cast(event_id % 6 as int) as attempts, 5 as max_attempts,
  ts + interval '1' minute * cast(event_id % 90 as int) as run_after,
  case when event_id % 8 in (2, 3) and event_id % 5 <> 0 then ts + interval '1' second * cast(event_id % 600 as int) else null end as heartbeat_at,
  case when event_id % 8 = 4 then '503 upstream' else null end as error, ts as enqueued_at,
  case when event_id % 8 in (0, 1) then null else ts + interval '1' second * cast(event_id % 45 as int) end as started_at,
  case when event_id % 4 = 0 then null else concat(event_type, '-', cast(event_id % 20 as string)) end as idempotency_key
from {events}
""",
    "dom_enqueue_requests": r"""
select event_id as id, user_id, user_id - user_id % 10 as account_id, event_type as kind,
  case when event_id % 6 = 0 then null else concat(event_type, '-', cast(event_id % 30 as string)) end as idempotency_key, ts as requested_at
from {events}
""",
    "dom_job_events": r"""
select event_id as seq, cast(floor(event_id / 20) as bigint) as job_id, ts,
  case event_type when 'view' then 'progress' when 'click' then 'claim' when 'purchase' then 'complete' when 'signup' then 'requeue' else 'fail' end as action,
  cast(case when event_id % 19 = 0 then null else event_id % 130 - 10 end as int) as progress,
  case when event_id % 3 = 0 then null else concat('note ', cast(event_id % 7 as string)) end as note
from {events}
""",
    "dom_errors": r"""
select event_id as id,
  cast(case event_id % 7 when 0 then 429 when 1 then 500 when 2 then 408 when 3 then 400 when 4 then 0 else null end as int) as status,
  case event_id % 5 when 0 then 'fetch failed' when 1 then 'Unexpected token' when 2 then 'ECONNRESET' when 3 then 'Network down' else null end as message,
  (event_id % 11 = 0) as fatal, concat('worker-', cast(user_id % 4 as string)) as worker, ts as created_at
from {events} where event_type = 'error'
""",
    "dom_policy_packs": r"""
select p_partkey as id, case when p_partkey % 3 = 0 then null else p_partkey % 50 end as account_id, p_brand as pack_key, case when p_partkey % 6 = 0 then null else p_partkey % 100 end as updated_by,
  cast(p_partkey as string) as version,
  case p_size % 5 when 0 then 'GB' when 1 then 'EU' when 2 then 'US' when 3 then 'CH' else 'ANY' end as jurisdiction,
  concat('["', p_name, '","', p_type, '"]') as rules, (p_partkey % 11 <> 0) as active,
  cast(date '1995-01-01' + cast(p_partkey % 2000 as int) as timestamp) as effective_from,
  case when p_partkey % 5 = 0 then null else cast(date '1995-01-01' + cast(p_partkey % 2000 + 200 + p_size * 10 as int) as timestamp) end as effective_to
from {part}
""",
    "dom_policy_snapshots": r"""
select event_id as analysis_id, cast(floor(event_id / 5) as bigint) as pack_id
from {events} where event_type in ('purchase', 'signup')
""",
    "dom_telemetry": r"""
select event_id as id, user_id as account_id, event_type as op,
  case when event_type = 'error' then null else cast(floor(value * 100) as int) end as duration_ms,
  case when event_type = 'error' then null else cast(event_id % 4000 as int) end as tokens_in,
  case when event_type = 'error' or event_id % 7 = 0 then null else cast(event_id % 900 as int) end as tokens_out,
  case when event_id % 50 = 0 then null else event_type <> 'error' end as ok,
  case when event_type <> 'error' then null when event_id % 7 = 0 then '429' when event_id % 7 = 1 then '500' when event_id % 7 = 2 then '400' else 'error' end as error_class,
  (event_type = 'error' and event_id % 11 = 0) as fatal,
  concat('worker-', cast(user_id % 4 as string)) as worker, ts as created_at
from {events}
""",
    "dom_documents": r"""
select doc_id as id, case when doc_id % 40 = 7 then null else concat('c', cast(doc_id - doc_id % 3 as string)) end as contract_id,
  concat('Document ', cast(doc_id as string), ' ', lang) as name, source as doc_type, n_chars as size_bytes, text as extracted_text,
  (doc_id % 5 = 0) as is_transcript, case when doc_id % 15 = 0 then null else doc_id % 60 end as consent_id,
  (n_chars < 200) as scanned, (doc_id % 7 = 0) as ocr_applied, cast(1 + doc_id % 12 as int) as page_count,
  timestamp '2024-01-01 00:00:00' + interval '1' hour * cast(doc_id % 700 as int) as created_at
from {documents}
""",
    "dom_consents": r"""
select c_custkey as id, c_custkey % 50 as account_id, c_name as accepted_name, case when c_custkey % 7 = 0 then null else c_custkey end as accepted_by,
  case when c_custkey % 2 = 0 then '2026.1' else '2025.2' end as version,
  timestamp '2023-12-20 00:00:00' + interval '1' hour * cast(c_custkey % 900 as int) as accepted_at
from {customer} where c_custkey % 60 <> 10
""",
    "dom_contract_users": r"""
select concat('c', cast(l_orderkey as string)) as contract_id, concat('user', cast(l_partkey as string)) as full_name, l_returnflag as team,
  case when l_linenumber % 4 = 0 then null else cast(l_shipdate as date) end as last_active, l_linestatus as licence_type
from {lineitem}
""",
    "dom_profiles": r"""
select c_custkey as id, concat('user', cast(c_custkey as string), '@', lower(c_mktsegment), '.example') as email, c_name as full_name
from {customer} where c_custkey % 8 <> 0
""",
    "dom_new_users": r"""
select c_custkey as id, concat('user', cast(c_custkey as string), '@', lower(c_mktsegment), '-group.example') as email,
  case c_custkey % 4 when 0 then '{{}}' when 1 then concat('{{"full_name":"', c_name, '"}}') when 2 then concat('{{"name":"', c_name, '","company":"Acme"}}') else '{{"full_name":null}}' end as meta
from {customer}
""",
    "dom_invitations": r"""
select c_custkey as id, c_custkey % 100 as account_id, case when c_custkey % 5 = 0 then null else c_custkey % 70 end as invited_by,
  lower(concat('user', cast(c_custkey as string), '@', c_mktsegment, '.example')) as email,
  case c_custkey % 3 when 0 then 'admin' when 1 then 'member' else 'viewer' end as role, concat('tok', cast(c_custkey as string)) as token,
  timestamp '2024-01-01 00:00:00' + interval '1' day * cast(c_custkey % 40 as int) as expires_at,
  case when c_custkey % 6 = 0 then timestamp '2024-01-02 00:00:00' else null end as accepted_at
from {customer}
""",
    "dom_accept_attempts": r"""
select event_id as id, case when event_id % 25 = 0 then null else user_id end as user_id, concat('tok', cast(cast(floor(event_id / 6) as bigint) as string)) as token,
  case when event_id % 3 = 0 then concat('USER', cast(cast(floor(event_id / 6) as bigint) as string), '@x.example')
       else concat('User', cast(cast(floor(event_id / 6) as bigint) as string), '@', coalesce(c_mktsegment, 'none'), '.Example') end as email, ts
from {events} left join {customer} on c_custkey = cast(floor(event_id / 6) as bigint)
""",
    "dom_signups": r"""
select c_custkey as id, case when c_custkey % 20 = 0 then '' else c_name end as first_name, case when c_custkey % 11 = 0 then ' ' else 'Doe' end as last_name,
  case when c_custkey % 9 = 0 then 'bad address' else concat('u', cast(c_custkey as string), '@', lower(c_mktsegment), '.co') end as email,
  case when c_custkey % 13 = 0 then '' else c_mktsegment end as company,
  case c_custkey % 5 when 0 then 'sandbox' when 1 then 'growth' when 2 then 'scale' when 3 then 'enterprise' else 'bogus' end as plan,
  (c_custkey % 4 <> 1) as terms
from {customer}
""",
    "dom_suppliers": r"""
select s_suppkey as id, case s_suppkey % 4 when 0 then concat(n, ' Ltd') when 1 then upper(n) when 2 then concat(n, ', Inc.') else n end as supplier
from (select s_suppkey, concat('Acme ', cast(s_suppkey % 25 as string)) as n from {supplier}) x
""",
    "dom_replies": r"""
select conv_id * 100 + turn as job_id, case conv_id % 4 when 0 then 'analysis' when 1 then 'reanalysis' else 'other' end as kind,
  case turn % 3 when 0 then concat('```json', chr(10), '{{"n":', cast(turn as string), '}}', chr(10), '```')
                when 1 then concat('Here: {{"n":', cast(conv_id as string), '}} done') else text end as reply
from {conversations}
""",
}
