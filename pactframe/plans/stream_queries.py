"""Streams over the event table, drained and compared with their batch twins."""

from pyspark.sql import functions as F

from pactframe.plans import jobs_queries  # noqa: F401  registers the batch twins
from pactframe.plans.ops_queries import HEALTH
from pactframe.plans.registry import oracle_of, register
from pactframe.session import new_folder
from pactframe.streaming import streams
from pactframe.streaming.runner import bound_stream, drain, drain_batches

# Windows the watermark has closed: ten minutes behind the newest event, whole milliseconds.
CLOSED = "(select date_trunc('milliseconds', max(ts)) - interval 10 minute from events)"


def telemetry(t):
    return bound_stream(t.spark, t.folder, "dom_telemetry", "events")


@register(
    "stream_ops_health",
    f"""select date_trunc('minute', created_at) as minute, op, {HEALTH} from dom_telemetry
    where date_trunc('minute', created_at) + interval 1 minute <= {CLOSED} group by 1, 2""",
)
def stream_ops_health(t):
    return drain(streams.stream_ops_health(telemetry(t)), "stream-ops-health")


@register(
    "stream_enqueue",
    """with asked as (select r.*, exists (select 1 from dom_members m where m.user_id = r.user_id and m.account_id = r.account_id
        and m.role in ('owner', 'admin', 'member')) as editor from dom_enqueue_requests r)
    select account_id, idempotency_key, 1::bigint as kept from asked r where editor and idempotency_key is not null
      and not exists (select 1 from dom_jobs j where j.account_id = r.account_id and j.idempotency_key = r.idempotency_key
        and j.status in ('queued', 'running', 'succeeded')) group by 1, 2
    union all
    select account_id, null, count(*) from asked where editor and idempotency_key is null group by 1""",
)
def stream_enqueue(t):
    requests = bound_stream(t.spark, t.folder, "dom_enqueue_requests", "events", in_parts=True)
    folder = new_folder(t.spark, "stream-enqueue")
    live = t("dom_jobs").select("account_id", "idempotency_key", "status")
    drain_batches(requests, "stream-enqueue", streams.EnqueueBatches(folder, live, t("dom_accounts"), t("dom_members")))
    kept = t.spark.read.parquet(f"{folder}/out").filter("outcome = 'queued'")
    return kept.groupBy("account_id", "idempotency_key").agg(F.count(F.lit(1)).alias("kept"))


@register(
    "stream_call_budget",
    f"""select account_id, date_trunc('hour', created_at) as hour, count(*) as calls, least(count(*), 1) as allowed,
      greatest(count(*) - 1, 0) as refused from dom_telemetry
    where date_trunc('hour', created_at) + interval 1 hour <= {CLOSED} group by 1, 2""",
)
def stream_call_budget(t):
    return drain(streams.stream_call_budget(telemetry(t), cap=1), "stream-call-budget")


@register(
    "stream_ops_24h",
    f"""with hours as (select date_trunc('hour', created_at) as hour, op, count(*) as ops, count(*) filter (where ok) as good,
        sum(tokens_in + tokens_out) as tokens from dom_telemetry group by 1, 2),
    placed as (select hour - interval 1 hour * i as window_start, op, ops, good, tokens from hours, range(0, 24) r(i))
    select window_start, window_start + interval 24 hour as window_end, op, cast(sum(ops) as bigint) as ops,
      round(100.0 * sum(good) / sum(ops), 1) as success_pct, cast(sum(tokens) as bigint) as tokens
    from placed where window_start + interval 24 hour <= {CLOSED} group by window_start, op""",
)
def stream_ops_24h(t):
    return drain(streams.stream_ops_24h(telemetry(t)), "stream-ops-24h")


@register("stream_failure_streaks", oracle_of("failure_streaks"))
def stream_failure_streaks(t):
    passing = ~F.col("fatal") & F.col("error_class").isin("429", "500")
    calls = bound_stream(t.spark, t.folder, "dom_telemetry", "events", in_parts=True)
    calls = calls.select("worker", "created_at", "id", "ok", passing.alias("retryable"))
    folder = new_folder(t.spark, "stream-failure-streaks")
    step = streams.StreakBatches(folder, lateness="3 days")
    drain_batches(calls, "stream-failure-streaks", step)
    step.finish(t.spark)
    return t.spark.read.parquet(f"{folder}/out").drop("batch")


@register("stream_job_state", oracle_of("job_state_fold"))
def stream_job_state(t):
    events = bound_stream(t.spark, t.folder, "dom_job_events", "events", in_parts=True)
    step = streams.JobStateBatches(new_folder(t.spark, "stream-job-state"))
    drain_batches(events, "stream-job-state", step)
    return step.states(t.spark)


@register(
    "stream_stale_jobs",
    f"""select id, heartbeat_at as last_heartbeat, heartbeat_at + interval 5 minute as stale_at from dom_jobs
    where status = 'running' and id % 3 <> 0 and heartbeat_at + interval 5 minute <=
      (select date_trunc('milliseconds', max(heartbeat_at + case when id % 3 = 0 then interval 1 minute else interval 0 minute end)) - interval 10 minute
       from dom_jobs where status = 'running')""",
)
def stream_stale_jobs(t):
    beats = bound_stream(t.spark, t.folder, "dom_jobs", "events").filter("status = 'running' and heartbeat_at is not null")
    # every third of these jobs ends a minute after its heartbeat
    end = F.struct((F.col("heartbeat_at") + F.expr("interval 1 minute")).alias("at"), F.lit("succeeded").alias("status"))
    beat = F.struct(F.col("heartbeat_at").alias("at"), F.lit("running").alias("status"))
    changes = beats.select("id", F.explode(F.when(F.col("id") % 3 == 0, F.array(beat, end)).otherwise(F.array(beat))).alias("c"))
    return drain(streams.stream_stale_jobs(changes.select("id", "c.*")), "stream-stale-jobs")


@register(
    "stream_telemetry_sink",
    """select cast(created_at as date) as day, op, count(*) as calls, count(*) filter (where ok) as good, count(distinct id) as ids,
      cast(coalesce(sum(tokens_in + tokens_out), 0) as bigint) as tokens from dom_telemetry group by 1, 2""",
)
def stream_telemetry_sink(t):
    """Telemetry appended by day, with a batch repeated and the days compacted halfway, read back and counted."""
    calls = bound_stream(t.spark, t.folder, "dom_telemetry", "events", in_parts=True)
    sink = streams.DailySink(new_folder(t.spark, "stream-telemetry"))

    def step(batch, batch_id):
        sink(batch, batch_id)
        if batch_id == 1:
            sink(batch, batch_id)
            sink.compact(batch.sparkSession, batch.schema)

    drain_batches(calls, "stream-telemetry", step)
    rows = sink.read(t.spark, calls.schema)
    return rows.groupBy("day", "op").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("good"), F.count_distinct("id").alias("ids"),
        F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).cast("long").alias("tokens"))


@register(
    "stream_stale_timers",
    f"""with signs as (select job_id as id, ts as seen, bool_or(action not in ('claim', 'progress', 'requeue')) as done
      from dom_job_events group by 1, 2),
    apart as (select *, coalesce(seen > lag(seen) over (partition by id order by seen) + interval 5 minute, true)::int as first from signs),
    spans as (select *, sum(first) over (partition by id order by seen) as span from apart)
    select id, min(seen) as alive_since, max(seen) as last_heartbeat, max(seen) + interval 5 minute as stale_at from spans group by id, span
    having not arg_max(done, seen) and max(seen) + interval 5 minute < (select date_trunc('milliseconds', max(ts)) - interval 3 day from events)""",
)
def stream_stale_timers(t):
    """Job events as signs of life that come over several micro-batches, some a batch late."""
    events = bound_stream(t.spark, t.folder, "dom_job_events", "events", in_parts=True)
    alive = F.when(F.col("action").isin("claim", "progress", "requeue"), "running").otherwise(F.col("action"))
    changes = events.select(F.col("job_id").alias("id"), F.col("ts").alias("at"), alive.alias("status"))
    return drain(streams.stream_stale_timers(changes, lateness="3 days"), "stream-stale-timers")
