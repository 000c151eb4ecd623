"""Job table queries."""

from pyspark.sql import functions as F

from pactframe.functions.spread import newest_per_key
from pactframe.operators import jobs
from pactframe.plans.registry import oracle_of, register
from pactframe.plans.times import AS_OF

NOW = f"timestamp '{AS_OF}'"
BACKOFF = "to_seconds(cast(10 * power(2, least(j.attempts, 6)) as integer))"
RETRYABLE = """not coalesce(fatal, false) and (coalesce(status, 0) = 429 or coalesce(status, 0) >= 500 or coalesce(status, 0) = 408
      or regexp_matches(coalesce(message, ''), 'network|fetch failed|timeout|econn', 'i'))"""
ERROR_TEXT = "trim(concat(coalesce(cast(status as varchar), ''), ' ', coalesce(message, '')))"


@register(
    "recent_jobs",
    f"""select j.id, j.contract_id, j.kind, j.status, j.attempts, j.enqueued_at, j.started_at, c.ref, c.supplier,
      cast(round((epoch_us({NOW}) - epoch_us(j.enqueued_at)) / 1e6) as integer) as age_seconds
    from dom_jobs j left join dom_contracts c on c.id = j.contract_id
    where j.enqueued_at > {NOW} - interval 24 hour and j.enqueued_at <= {NOW}""",
)
def recent_jobs(t):
    columns = ["id", "contract_id", "kind", "status", "attempts", "enqueued_at", "started_at"]
    found = jobs.recent_jobs(t("dom_jobs").select("account_id", *columns), t("dom_contracts"), AS_OF)
    return found.select(*columns, "ref", "supplier", "age_seconds")


@register(
    "dead_letter_jobs",
    """select j.id, j.account_id, j.contract_id, j.kind, j.status, j.priority, j.attempts, j.max_attempts, j.run_after,
      j.requested_by, j.heartbeat_at, j.error, j.enqueued_at, j.started_at, j.idempotency_key, c.ref, c.supplier
    from dom_jobs j left join dom_contracts c on c.id = j.contract_id where j.status = 'dead'""",
)
def dead_letter_jobs(t):
    return jobs.dead_letter_jobs(t("dom_jobs"), t("dom_contracts"))


@register(
    "queue_depth",
    f"""select kind, status, count(*) as n, (epoch_us({NOW}) - epoch_us(min(enqueued_at))) / 1e6 as oldest_seconds
    from dom_jobs where status in ('queued', 'running') group by kind, status""",
)
def queue_depth(t):
    return jobs.queue_depth(t("dom_jobs"), AS_OF)


@register("due_jobs", f"select count(*) as waiting from dom_jobs where status = 'queued' and run_after <= {NOW}")
def due_jobs(t):
    return jobs.due_jobs(t("dom_jobs"), AS_OF)


@register(
    "claimable_jobs",
    f"""select id, account_id, kind, priority, run_after from dom_jobs where status = 'queued' and run_after <= {NOW}
      and kind in ('analysis', 'reanalysis') order by priority, run_after, id limit 3""",
)
def claimable_jobs(t):
    found = jobs.claimable_jobs(t("dom_jobs"), AS_OF, ["analysis", "reanalysis"], 3)
    return found.select("id", "account_id", "kind", "priority", "run_after")


@register(
    "claimable_per_account",
    f"""select id, account_id, kind, priority, run_after, cast(position as integer) as position from (
      select *, row_number() over (partition by account_id order by priority, run_after, id) as position
      from dom_jobs where status = 'queued' and run_after <= {NOW}) x where position <= 3""",
)
def claimable_per_account(t):
    return jobs.claimable_per_account(t("dom_jobs"), AS_OF, 3).select(
        "id", "account_id", "kind", "priority", "run_after", "position"
    )


@register(
    "stale_jobs",
    f"""select j.id, j.account_id, j.attempts, case when attempts >= max_attempts then 'dead' else 'queued' end as status,
      {NOW} + {BACKOFF} as run_after, cast(null as varchar) as locked_by, coalesce(error, 'worker heartbeat lost') as error
    from dom_jobs j where status = 'running' and heartbeat_at < {NOW} - interval 5 minute""",
)
def stale_jobs(t):
    return jobs.stale_jobs(t("dom_jobs"), AS_OF)


@register(
    "classify_errors",
    f"select id, status, message, fatal, {RETRYABLE} as retryable from dom_errors",
)
def classify_errors(t):
    return jobs.classify_errors(t("dom_errors")).select("id", "status", "message", "fatal", "retryable")


@register(
    "error_text",
    f"select id, {ERROR_TEXT} as error, coalesce(cast(status as varchar), 'error') as error_class from dom_errors",
)
def error_text(t):
    return jobs.error_text(t("dom_errors")).select("id", "error", "error_class")


@register(
    "apply_failures",
    f"""with failures as (select id, {RETRYABLE} as retryable, {ERROR_TEXT} as error from dom_errors)
    select j.id, j.attempts, case when f.retryable and j.attempts < j.max_attempts then 'queued' else 'dead' end as status,
      case when f.retryable and j.attempts < j.max_attempts then {NOW} + {BACKOFF} else j.run_after end as run_after,
      f.error, case when f.retryable and j.attempts < j.max_attempts then null else {NOW} end as finished_at,
      case when f.retryable and j.attempts < j.max_attempts then 'Retrying…' else 'Failed — needs investigation' end as progress_note,
      cast(null as varchar) as locked_by
    from dom_jobs j join failures f on f.id = j.id""",
)
def apply_failures(t):
    failures = jobs.error_text(jobs.classify_errors(t("dom_errors"))).select("id", "error", "retryable")
    return jobs.apply_failures(t("dom_jobs"), failures, AS_OF)


@register(
    "apply_completions",
    f"""select j.id, 'succeeded' as status, 100 as progress, r.reply as result, {NOW} as finished_at,
      cast(null as varchar) as locked_by, cast(null as varchar) as error
    from dom_jobs j join dom_replies r on r.job_id = j.id""",
)
def apply_completions(t):
    results = t("dom_replies").select(F.col("job_id").alias("id"), F.col("reply").alias("result"))
    return jobs.apply_completions(t("dom_jobs"), results, AS_OF)


@register(
    "apply_progress",
    f"""with newest as (select * from (select *, row_number() over (partition by job_id order by ts desc, seq desc) as rn
      from dom_job_events where action = 'progress') x where rn = 1)
    select j.id, cast(greatest(0, least(100, n.progress)) as integer) as progress,
      coalesce(n.note, 'step ' || cast(j.attempts as varchar)) as progress_note, {NOW} as heartbeat_at
    from dom_jobs j join newest n on n.job_id = j.id""",
)
def apply_progress(t):
    reports = t("dom_job_events").filter("action = 'progress'").select("job_id", "ts", "seq", "progress", "note")
    newest = newest_per_key(reports, ["job_id"], ["ts", "seq"]).withColumnRenamed("job_id", "id")
    noted = t("dom_jobs").withColumn("progress_note", F.concat(F.lit("step "), F.col("attempts").cast("string")))
    return jobs.apply_progress(noted, newest, AS_OF)


@register(
    "requeue_dead",
    f"""select distinct j.id, j.account_id, 'queued' as status, 0 as attempts, {NOW} as run_after,
      cast(null as varchar) as error, 0 as progress, 'Requeued manually' as progress_note
    from dom_jobs j join dom_contract_actions r on r.id = j.id
    join dom_members m on m.user_id = r.user_id and m.account_id = j.account_id and m.role in ('owner', 'admin')
    where j.status = 'dead'""",
)
def requeue_dead(t):
    return jobs.requeue_dead(t("dom_jobs"), t("dom_contract_actions"), t("dom_members"), AS_OF)


@register(
    "enqueue_batch",
    """with asked as (select r.*, m.role is not null as editor from dom_enqueue_requests r
        left join dom_members m on m.user_id = r.user_id and m.account_id = r.account_id
          and m.role in ('owner', 'admin', 'member')),
    ranked as (select *, row_number() over (partition by editor, account_id, idempotency_key order by requested_at, id) as rn from asked),
    decided as (select r.id, r.user_id, r.account_id, r.kind, r.idempotency_key, r.requested_at, a.plan,
        case when not r.editor then 'rejected'
          when r.idempotency_key is not null and exists (select 1 from dom_jobs j where j.account_id = r.account_id
            and j.idempotency_key = r.idempotency_key and j.status in ('queued', 'running', 'succeeded')) then 'existing'
          when r.idempotency_key is not null and r.rn > 1 then 'collapsed' else 'queued' end as outcome
      from ranked r left join dom_accounts a on a.account_id = r.account_id)
    select id, user_id, account_id, kind, idempotency_key, requested_at, outcome,
      case when outcome = 'queued' then case plan when 'enterprise' then 10 when 'scale' then 30 when 'growth' then 50 else 100 end end as priority
    from decided""",
)
def enqueue_batch(t):
    return jobs.enqueue_decisions(t("dom_enqueue_requests"), t("dom_jobs"), t("dom_accounts"), t("dom_members"))


@register(
    "failure_streaks",
    """with calls as (select worker, created_at, id, coalesce(ok, false) as won,
        coalesce(not ok and not fatal and error_class in ('429', '500'), false) as lost from dom_telemetry),
    islands as (select *, sum(won::int) over (partition by worker order by created_at, id) as island from calls),
    counted as (select *, cast(sum(lost::int) over (partition by worker, island order by created_at, id) as bigint) as streak from islands)
    select worker, created_at, id, streak, streak >= 4 as opened,
      case when streak >= 4 then created_at + interval 60 second end as open_until from counted where lost""",
)
def failure_streaks(t):
    passing = ~F.col("fatal") & F.col("error_class").isin("429", "500")
    calls = t("dom_telemetry").select("worker", "created_at", "id", "ok", passing.alias("retryable"))
    return jobs.failure_streaks(calls)


@register(
    "breaker_spans",
    f"""with streaks as ({oracle_of("failure_streaks")}),
    wins as (select worker, created_at, id, true as won, cast(null as timestamp) as open_until from dom_telemetry where ok),
    marks as (select worker, created_at, id, false as won, created_at + interval 30 minute as open_until from streaks where streak >= 2 union all select * from wins),
    holds as (select *, least(open_until, min(case when won then created_at end) over (
        partition by worker order by created_at, id rows between 1 following and unbounded following)) as closes from marks),
    opens as (select *, max(closes) over (partition by worker order by created_at, id rows between unbounded preceding and 1 preceding) as before
      from holds where not won),
    spans as (select *, sum(case when created_at <= before then 0 else 1 end) over (partition by worker order by created_at, id) as span from opens)
    select worker, min(created_at) as opened_at, max(closes) as closed_at, count(*) as failures,
      date_diff('microsecond', min(created_at), max(closes)) / 1e6 as seconds_open from spans group by worker, span""",
)
def breaker_spans(t):
    """The test table has few failures in a row and few calls a minute, so two of them open a breaker for half an hour."""
    passing = ~F.col("fatal") & F.col("error_class").isin("429", "500")
    return jobs.breaker_spans(t("dom_telemetry").select("worker", "created_at", "id", "ok", passing.alias("retryable")), 2, "30 minutes")


@register(
    "job_state_fold",
    """with requeued as (select job_id, max((ts, seq)) as at from dom_job_events where action = 'requeue' group by job_id),
    claims as (select e.job_id, count(*) as attempts from dom_job_events e left join requeued r on r.job_id = e.job_id
      where e.action = 'claim' and (r.at is null or (e.ts, e.seq) > r.at) group by e.job_id),
    last_action as (select job_id, action from (select *, row_number() over (partition by job_id order by ts desc, seq desc) as rn
      from dom_job_events where action <> 'progress') x where rn = 1),
    last_progress as (select job_id, case action when 'progress' then greatest(0, least(100, progress)) when 'complete' then 100 else 0 end as progress
      from (select *, row_number() over (partition by job_id order by ts desc, seq desc) as rn
        from dom_job_events where action in ('progress', 'complete', 'requeue')) x where rn = 1),
    last_note as (select job_id, note from (select *, row_number() over (partition by job_id order by ts desc, seq desc) as rn
      from dom_job_events where note is not null) x where rn = 1),
    seen as (select job_id, count(*) as events from dom_job_events group by job_id)
    select s.job_id, case when a.action = 'claim' then 'running' when a.action = 'complete' then 'succeeded'
        when a.action = 'fail' and coalesce(c.attempts, 0) >= 5 then 'dead' else 'queued' end as status,
      coalesce(c.attempts, 0) as attempts, cast(coalesce(p.progress, 0) as integer) as progress, n.note, s.events
    from seen s left join claims c using (job_id) left join last_action a using (job_id)
    left join last_progress p using (job_id) left join last_note n using (job_id)""",
)
def job_state_fold(t):
    return jobs.job_state_fold(t("dom_job_events"))


@register(
    "queue_wait",
    """select id, account_id, cast(floor((epoch_us(started_at) - epoch_us(enqueued_at)) / 1000.0) as bigint) as queue_wait_ms
    from dom_jobs""",
)
def queue_wait(t):
    return jobs.queue_wait(t("dom_jobs")).select("id", "account_id", "queue_wait_ms")


# Payloads of the test jobs: prompts of every JSON type, message arrays, and neither.
PAYLOAD = """case event_id % 9 when 0 then '{"prompt":"Summarise ' || event_type || '"}' when 1 then '{"prompt":""}' when 2 then '{"messages":[{"role":"user","content":"hi"}]}'
      when 3 then '{"messages":"none"}' when 4 then '{"prompt":null,"messages":[]}' when 5 then '{"prompt":"0"}' when 6 then '{"prompt":false}' when 7 then 'not json'
      else '{"prompt":' || cast(event_id % 2 as string) || '}' end"""


@register(
    "payload_checks",
    f"""select event_id as id, case when not coalesce((json_type(p, '$.prompt') = 'VARCHAR' and json_extract_string(p, '$.prompt') <> '')
        or (json_type(p, '$.prompt') in ('UBIGINT', 'BIGINT') and try_cast(json_extract_string(p, '$.prompt') as bigint) <> 0)
        or coalesce(json_type(p, '$.messages') = 'ARRAY', false), false) then 'Job payload has no prompt' end as invalid_reason
    from (select event_id, case when json_valid(payload) then payload end as p from (select event_id, {PAYLOAD} as payload from events) y) x""",
)
def payload_checks(t):
    rows = t.base("events").select(F.col("event_id").alias("id"), F.expr(PAYLOAD).alias("payload"))
    return jobs.payload_checks(rows).select("id", "invalid_reason")


@register(
    "charge_rows",
    """select id as job_id, account_id, contract_id, 'analysis' as kind, 10 as credits from dom_jobs
    where status = 'succeeded' and kind in ('analysis', 'reanalysis') and contract_id is not null
      and id not in (select id from dom_credit_ledger where kind = 'analysis' and id % 3 = 0)""",
)
def charge_rows(t):
    charged = t("dom_credit_ledger").filter("kind = 'analysis' and id % 3 = 0").select(F.col("id").alias("job_id"))
    return jobs.charge_rows(t("dom_jobs"), charged)


@register(
    "latest_analysis",
    """select id, contract_id, analysis, created_at from (select *, row_number() over
      (partition by contract_id order by created_at desc, id desc) as rn from dom_analyses) x where rn = 1""",
)
def latest_analysis(t):
    return jobs.latest_analysis(t("dom_analyses"))


@register(
    "telemetry_rows",
    """select c.id, j.account_id, j.kind as op, case when c.good then c.duration_ms end as duration_ms,
      case when c.good then c.tokens_in end as tokens_in, case when c.good then c.tokens_out end as tokens_out,
      case when c.good then cast(floor((epoch_us(j.started_at) - epoch_us(j.enqueued_at)) / 1000.0) as bigint) end as queue_wait_ms,
      c.good as ok, case when not c.good then coalesce(cast(try_cast(c.error_class as integer) as varchar), 'error') end as error_class,
      c.worker, c.created_at
    from (select *, coalesce(ok, false) as good from dom_telemetry) c join dom_jobs j on j.id = c.id""",
)
def telemetry_rows(t):
    calls = t("dom_telemetry").select(
        "id",
        F.col("id").alias("job_id"),
        "created_at",
        "duration_ms",
        "tokens_in",
        "tokens_out",
        "ok",
        F.expr("try_cast(error_class as int)").alias("status"),
        "worker",
    )
    return jobs.telemetry_rows(t("dom_jobs"), calls)
