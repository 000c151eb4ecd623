"""Job table reports and next-state computation over whole tables.

Each state operator takes the jobs and a batch of outcomes and returns the
changed rows; writing them back is the caller's merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pactframe.functions.columns import instant, retry_at, seconds_between, whole_seconds_between
from pactframe.functions.spread import newest_per_key
from pactframe.operators.asof import following, running_sum
from pactframe.operators.ops import last_24_hours
from pactframe.operators.tenancy import ADMIN_ROLES, EDITOR_ROLES, by_account, in_scope
from pactframe.sources.tables import stored

# Statuses that block a second job with the same key, and the
# priority of each plan.
LIVE = ("queued", "running", "succeeded")
PLAN_PRIORITY = {"enterprise": 10, "scale": 30, "growth": 50}
DEFAULT_PRIORITY = 100
NOTE_RETRYING = "Retrying…"
NOTE_DEAD = "Failed — needs investigation"
NOTE_REQUEUED = "Requeued manually"
LOST_HEARTBEAT = "worker heartbeat lost"


# ---- reports -------------------------------------------------------------


def _contract_names(contracts: DataFrame) -> DataFrame:
    return contracts.select(F.col("id").alias("contract_id"), "ref", "supplier")


def recent_jobs(jobs: DataFrame, contracts: DataFrame, as_of, scope: DataFrame | None = None) -> DataFrame:
    """Jobs of the last 24 hours with contract names and age in whole seconds."""
    recent = last_24_hours(in_scope(jobs, scope), as_of, "enqueued_at")
    named = recent.join(_contract_names(contracts), "contract_id", "left")
    return named.withColumn("age_seconds", whole_seconds_between(F.col("enqueued_at"), instant(as_of)))


def dead_letter_jobs(jobs: DataFrame, contracts: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    dead = in_scope(jobs.filter(F.col("status") == "dead"), scope)
    return dead.join(_contract_names(contracts), "contract_id", "left")


def queue_depth(jobs: DataFrame, as_of, scope: DataFrame | None = None) -> DataFrame:
    """Open jobs by kind and status with the age of the oldest, due or not."""
    open_jobs = in_scope(jobs, scope).filter(F.col("status").isin("queued", "running"))
    sums = open_jobs.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.min("enqueued_at").alias("_oldest"))
    return sums.select("kind", "status", "n", seconds_between(F.col("_oldest"), instant(as_of)).alias("oldest_seconds"))


def _due(jobs: DataFrame, as_of) -> DataFrame:
    return jobs.filter((F.col("status") == "queued") & (F.col("run_after") <= instant(as_of)))


def due_jobs(jobs: DataFrame, as_of, scope: DataFrame | None = None) -> DataFrame:
    """How many queued jobs could start now."""
    return _due(in_scope(jobs, scope), as_of).agg(F.count(F.lit(1)).alias("waiting"))


def claimable_jobs(jobs: DataFrame, as_of, kinds: list[str] | None = None, n: int = 1, scope: DataFrame | None = None) -> DataFrame:
    """The next n jobs in claim order: priority, then due time, then id."""
    ready = _due(in_scope(jobs, scope), as_of)
    if kinds is not None:
        ready = ready.filter(F.col("kind").isin(*kinds))
    return ready.orderBy("priority", "run_after", "id").limit(n)


def claimable_per_account(jobs: DataFrame, as_of, n: int = 3, scope: DataFrame | None = None) -> DataFrame:
    """The next n jobs of every account."""
    order = W.partitionBy("account_id").orderBy("priority", "run_after", "id")
    ready = _due(in_scope(jobs, scope), as_of)
    return ready.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def queue_wait(jobs: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Milliseconds from enqueue to the first start; NULL when never started."""
    waited = F.floor((F.unix_micros("started_at") - F.unix_micros("enqueued_at")) / 1000).cast("long")
    return in_scope(jobs, scope).withColumn("queue_wait_ms", waited)


# ---- next states ---------------------------------------------------------


def _retry_or_dead(can_retry: Column) -> Column:
    return F.when(can_retry, "queued").otherwise("dead")


def stale_jobs(jobs: DataFrame, as_of, stale_after: str = "5 minutes", scope: DataFrame | None = None) -> DataFrame:
    """Running jobs whose heartbeat is too old, in their next state.

    A job without any heartbeat is never stale.  The due time moves even for a
    job that is given up.
    """
    now = instant(as_of)
    lost = in_scope(jobs, scope).filter(
        (F.col("status") == "running") & (F.col("heartbeat_at") < now - F.expr(f"interval {stale_after}"))
    )
    return lost.select(
        "id",
        "account_id",
        "attempts",
        _retry_or_dead(F.col("attempts") < F.col("max_attempts")).alias("status"),
        retry_at(now, F.col("attempts")).alias("run_after"),
        F.lit(None).cast("string").alias("locked_by"),
        F.coalesce("error", F.lit(LOST_HEARTBEAT)).alias("error"),
    )


def apply_failures(jobs: DataFrame, failures: DataFrame, as_of) -> DataFrame:
    """Next state of failed jobs; ``failures`` has (id, error, retryable), one row per job.

    Retryable with attempts left goes back to the queue after a delay, anything
    else is kept as dead.  Unknown ids are ignored.
    """
    now = instant(as_of)
    reported = failures.select("id", F.col("error").alias("_error"), F.coalesce("retryable", F.lit(False)).alias("_retryable"))
    again = F.col("_retryable") & (F.col("attempts") < F.col("max_attempts"))
    return jobs.join(reported, "id").select(
        "id",
        "attempts",
        _retry_or_dead(again).alias("status"),
        F.when(again, retry_at(now, F.col("attempts"))).otherwise(F.col("run_after")).alias("run_after"),
        F.col("_error").alias("error"),
        F.when(~again, now).alias("finished_at"),
        F.when(again, NOTE_RETRYING).otherwise(NOTE_DEAD).alias("progress_note"),
        F.lit(None).cast("string").alias("locked_by"),
    )


def apply_completions(jobs: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Next state of finished jobs; ``results`` has (id, result), one row per job."""
    return jobs.join(results.select("id", "result"), "id").select(
        "id",
        F.lit("succeeded").alias("status"),
        F.lit(100).alias("progress"),
        "result",
        instant(as_of).alias("finished_at"),
        F.lit(None).cast("string").alias("locked_by"),
        F.lit(None).cast("string").alias("error"),
    )


def clamp_progress(progress: Column) -> Column:
    """Into 0..100; a missing value becomes 100, as least and greatest skip NULL."""
    return F.greatest(F.lit(0), F.least(F.lit(100), progress)).cast("int")


def apply_progress(jobs: DataFrame, updates: DataFrame, as_of) -> DataFrame:
    """Next state after progress reports; ``updates`` has (id, progress, note), one row per job.

    A report without a note keeps the old note.
    """
    reported = updates.select("id", F.col("progress").alias("_progress"), F.col("note").alias("_note"))
    return jobs.join(reported, "id").select(
        "id",
        clamp_progress(F.col("_progress")).alias("progress"),
        F.coalesce("_note", "progress_note").alias("progress_note"),
        instant(as_of).alias("heartbeat_at"),
    )


def requeue_dead(jobs: DataFrame, requests: DataFrame, members: DataFrame, as_of) -> DataFrame:
    """Dead jobs put back by an admin of their account; ``requests`` has (id, user_id)."""
    admins = members.filter(F.col("role").isin(*ADMIN_ROLES)).select("user_id", "account_id")
    dead = jobs.filter(F.col("status") == "dead").select("id", "account_id")
    allowed = (
        requests.select("id", "user_id")
        .join(dead, "id")
        .join(admins, ["user_id", "account_id"], "left_semi")
        .select("id", "account_id")
        .distinct()
    )
    return allowed.select(
        "id",
        "account_id",
        F.lit("queued").alias("status"),
        F.lit(0).alias("attempts"),
        instant(as_of).alias("run_after"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("progress"),
        F.lit(NOTE_REQUEUED).alias("progress_note"),
    )


# ---- enqueue -------------------------------------------------------------


def plan_priority(plan: Column) -> Column:
    chain = F.lit(DEFAULT_PRIORITY)
    for name, value in PLAN_PRIORITY.items():
        chain = F.when(plan == name, value).otherwise(chain)
    return chain


def enqueue_decisions(requests: DataFrame, jobs: DataFrame, accounts: DataFrame, members: DataFrame) -> DataFrame:
    """Every request with its outcome.

    rejected: the user may not edit the account; existing: a live job has the
    key; collapsed: an earlier request of the batch has the key; queued: a new
    job with the priority of the account's plan.  A request without a key is
    never taken for a repeat.
    """
    editors = (
        members.filter(F.col("role").isin(*EDITOR_ROLES)).select("user_id", "account_id").distinct()
        .withColumn("_editor", F.lit(True))
    )
    # requests without a key get one of their own, so they do not gather in one task
    own_key = F.concat(F.lit("id:"), F.col("id").cast("string"))
    asked = requests.withColumn("_key", F.coalesce(F.concat(F.lit("key:"), F.col("idempotency_key")), own_key))
    asked = asked.join(editors, ["user_id", "account_id"], "left")
    key = ["account_id", "_key"]
    # live jobs and first requests in one lookup: map tasks reduce a busy key to one row
    live = jobs.filter(F.col("status").isin(*LIVE) & F.col("idempotency_key").isNotNull()).select(
        "account_id", F.concat(F.lit("key:"), F.col("idempotency_key")).alias("_key"), F.lit(True).alias("_live")
    )
    wanted = asked.filter("_editor").select(*key, F.struct("requested_at", "id").alias("_ask"))
    known = wanted.unionByName(live, allowMissingColumns=True).groupBy(*key).agg(
        F.min("_ask").alias("_first"), F.max("_live").alias("_live")
    )
    plans = by_account(accounts).select("account_id", "plan")
    outcome = (
        F.when(F.col("_editor").isNull(), "rejected")
        .when(F.col("_live"), "existing")
        .when(F.col("_first.id") != F.col("id"), "collapsed")
        .otherwise("queued")
    )
    priority = F.when(F.col("outcome") == "queued", plan_priority(F.col("plan")))
    return (
        asked.join(known, key, "left")
        .withColumn("outcome", outcome)
        .join(plans, "account_id", "left")
        .select(*requests.columns, "outcome", priority.alias("priority"))
    )


def enqueue_batch(
    requests: DataFrame, jobs: DataFrame, accounts: DataFrame, members: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New jobs, and the requests that were taken for a repeat."""
    decided = enqueue_decisions(requests, jobs, accounts, members)
    return (
        decided.filter(F.col("outcome") == "queued"),
        decided.filter(F.col("outcome").isin("existing", "collapsed")),
    )


# ---- errors --------------------------------------------------------------

# Fixed value: message parts that mark a passing fault.
PASSING_FAULT = r"(?i)network|fetch failed|timeout|ECONN"


def is_retryable(status: Column, message: Column, fatal: Column) -> Column:
    """429, 408, 5xx and network faults may be retried unless the error is fatal."""
    code = F.coalesce(status, F.lit(0))
    passing = (code == 429) | (code >= 500) | (code == 408) | F.coalesce(message, F.lit("")).rlike(PASSING_FAULT)
    return ~F.coalesce(fatal, F.lit(False)) & passing


def classify_errors(errors: DataFrame) -> DataFrame:
    return errors.withColumn("retryable", is_retryable(F.col("status"), F.col("message"), F.col("fatal")))


def error_text(errors: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Adds the error text and the error class.

    The text is whole unless ``max_chars`` gives the size of a column that is to hold it (500, say).
    """
    joined = F.concat_ws(" ", F.coalesce(F.col("status").cast("string"), F.lit("")), F.coalesce("message", F.lit("")))
    trimmed = F.regexp_replace(joined, r"(?U)^\s+|\s+$", "")
    return errors.select(
        "*",
        (trimmed if max_chars is None else F.substring(trimmed, 1, max_chars)).alias("error"),
        F.coalesce(F.col("status").cast("string"), F.lit("error")).alias("error_class"),
    )


def _open_before(items: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """For each (worker, bucket), the unbroken failures just before it.

    ``items`` has one row per worker and bucket: ``_reset``, whether the bucket
    has a success, and ``_tail``, its failures since the last success (all of
    them without one).  Buckets are ordered inside the next wider bucket only;
    what lies before that comes from the wider buckets in the same way.
    """
    inside = ["worker", "_wide"] if levels else ["worker"]
    wide = items.withColumn("_wide", F.date_trunc(levels[0], "_bucket")) if levels else items
    order = W.partitionBy(*inside).orderBy("_bucket")
    wide = wide.withColumn("_run", F.sum(F.col("_reset").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    in_run = W.partitionBy(*inside, "_run").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    wide = wide.withColumn("_open", F.sum("_tail").over(in_run))
    near = wide.select(
        *inside,
        "_bucket",
        F.coalesce(F.lag("_open").over(order), F.lit(0)).alias("_carried"),
        (F.coalesce(F.lag("_run").over(order), F.lit(0)) > 0).alias("_broken"),
    )
    if not levels:
        return near.select("worker", "_bucket", "_carried")
    ends = wide.groupBy("worker", F.col("_wide").alias("_bucket")).agg(
        F.max("_reset").alias("_reset"), F.max_by("_open", "_bucket").alias("_tail")
    )
    far = _open_before(ends, levels[1:]).select("worker", F.col("_bucket").alias("_wide"), F.col("_carried").alias("_far"))
    carried = F.col("_carried") + F.when(F.col("_broken"), 0).otherwise(F.col("_far"))
    return near.join(far, inside).select("worker", "_bucket", carried.alias("_carried"))


def failure_streaks(
    calls: DataFrame, threshold: int = 4, hold: str = "60 seconds", levels: tuple[str, ...] = ("second", "hour"),
    carried: DataFrame | None = None,
) -> DataFrame:
    """Retryable failures with the running streak of their worker.

    ``calls`` has (worker, created_at, id, ok, retryable).  A success resets the
    streak, a failure that is not retryable neither counts nor resets, and each
    failure at or beyond the threshold opens a new hold.  ``carried`` has
    (worker, open), the unbroken failures of a worker before all of ``calls``.

    There are few workers, so a worker's log is never ordered as a whole: calls
    are ordered inside one of its seconds, its seconds inside an hour, and its
    hours by worker.
    """
    counted = calls.select(
        "worker",
        "created_at",
        "id",
        F.coalesce(F.col("ok"), F.lit(False)).alias("_won"),
        F.coalesce(~F.col("ok") & F.col("retryable"), F.lit(False)).cast("int").alias("_hit"),
        F.date_trunc(levels[0], "created_at").alias("_bucket"),
    )
    inside = W.partitionBy("worker", "_bucket").orderBy("created_at", "id").rowsBetween(W.unboundedPreceding, 0)
    lines = counted.withColumn("_hits", F.sum("_hit").over(inside))
    # failures up to the last success of the bucket, NULL before the first one
    lines = lines.withColumn("_base", F.max(F.when(F.col("_won"), F.col("_hits"))).over(inside))
    buckets = lines.groupBy("worker", "_bucket").agg(
        F.max("_won").alias("_reset"), (F.max("_hits") - F.coalesce(F.max("_base"), F.lit(0))).alias("_tail")
    )
    if carried is not None:
        # a bucket like any other, before all others
        first = F.lit("0001-01-01 00:00:00").cast("timestamp").alias("_bucket")
        buckets = buckets.unionByName(carried.select("worker", first, F.lit(True).alias("_reset"), F.col("open").alias("_tail")))
    before = _open_before(buckets, levels[1:])
    streak = F.when(F.col("_base").isNull(), F.col("_hits") + F.col("_carried")).otherwise(F.col("_hits") - F.col("_base"))
    opened = F.col("streak") >= threshold
    return (
        lines.filter(F.col("_hit") == 1)
        .join(before, ["worker", "_bucket"])
        .withColumn("streak", streak.cast("long"))
        .select(
            "worker",
            "created_at",
            "id",
            "streak",
            opened.alias("opened"),
            F.when(opened, F.col("created_at") + F.expr(f"interval {hold}")).alias("open_until"),
        )
    )


def breaker_spans(calls: DataFrame, threshold: int = 4, hold: str = "60 seconds") -> DataFrame:
    """When the breaker of each worker was open: (worker, opened_at, closed_at, failures, seconds_open).

    Each failure at or beyond the threshold opens it for ``hold``; a failure
    while it is open makes it stay longer; a success closes it at once.  Holds
    that overlap or touch are one span; ``failures`` are those that opened or
    prolonged it.

    A hold ends after the one before it or at the same time, so a span begins
    where the hold before has ended.  Instants are compared inside an hour of a
    worker, and hours by worker, never a worker's whole log in one task.
    """
    on = ["worker"]
    opened = failure_streaks(calls, threshold, hold).filter("opened").groupBy(*on, "created_at").agg(
        F.count(F.lit(1)).alias("failures"), F.max("id").alias("_id"), F.max("open_until").alias("open_until"))
    opened = stored(opened, "breaker-holds")
    wins = calls.filter(F.col("ok") & F.col("created_at").isNotNull()).groupBy(*on, "created_at").agg(F.max("id").alias("_win"))
    cut = following(opened, wins, on, "created_at")
    # a success of the same instant closes it only if it came after the failure
    same = F.when(F.col("_win") > F.col("_id"), F.col("created_at"))
    ends = opened.join(cut, [*on, "created_at"]).join(wins, [*on, "created_at"], "left").select(
        *on, "created_at", "failures", F.least("open_until", "next", same).alias("end")).withColumn("_hour", F.date_trunc("hour", "created_at"))
    ends = stored(ends, "breaker-ends")
    hours = ends.groupBy(*on, "_hour").agg(F.max("end").alias("_last"))
    earlier = hours.select(*on, "_hour", F.lag("_last").over(W.partitionBy(*on).orderBy("_hour")).alias("_earlier"))
    before = F.coalesce(F.lag("end").over(W.partitionBy(*on, "_hour").orderBy("created_at")), F.col("_earlier"))
    begins = ends.join(earlier, [*on, "_hour"]).withColumn("_before", before).select(
        *on, "created_at", F.when(F.col("created_at") <= F.col("_before"), 0).otherwise(1).alias("span"))
    numbered = running_sum(begins, on, "created_at", ["span"])
    spans = ends.join(numbered, [*on, "created_at"]).groupBy(*on, "span").agg(
        F.min("created_at").alias("opened_at"), F.max("end").alias("closed_at"), F.sum("failures").alias("failures"))
    seconds = (F.unix_micros(F.col("closed_at").cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / F.lit(1e6)
    return spans.select(*on, "opened_at", "closed_at", "failures", seconds.alias("seconds_open"))


# ---- change feed ---------------------------------------------------------


def job_state_fold(events: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Current state of each job from its lifecycle events.

    ``events`` has (job_id, seq, ts, action, progress, note) with the actions
    claim, progress, complete, fail and requeue.  Attempts are the claims since
    the last requeue; a failure with attempts left means queued again.
    """
    at = F.struct("ts", "seq")
    action = F.col("action")
    progress = (
        F.when(action == "progress", clamp_progress(F.col("progress")))
        .when(action == "complete", 100)
        .when(action == "requeue", 0)
    )
    state = events.groupBy("job_id").agg(
        F.max_by(action, F.when(action != "progress", at)).alias("_last"),
        F.coalesce(F.max_by(progress, F.when(progress.isNotNull(), at)), F.lit(0)).alias("progress"),
        F.max_by("note", F.when(F.col("note").isNotNull(), at)).alias("note"),
        F.max(F.when(action == "requeue", at)).alias("_requeued"),
        F.count_if(action == "claim").alias("_claims"),
        F.count(F.lit(1)).alias("events"),
    )
    # claims are counted per hour first; only those in the hour of the last requeue are looked at one by one
    hour = F.date_trunc("hour", "ts")
    requeued = events.filter(action == "requeue").groupBy("job_id").agg(F.max(at).alias("_requeued"))
    requeued = requeued.withColumn("_hour", F.date_trunc("hour", "_requeued.ts"))
    claimed = events.filter(action == "claim").select("job_id", "ts", "seq", hour.alias("_hour"))
    hourly = claimed.groupBy("job_id", "_hour").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_hour", "_at")
    later = hourly.join(requeued, "job_id").filter(F.col("_at") > F.col("_hour")).select("job_id", "n")
    same = claimed.join(requeued, ["job_id", "_hour"]).filter(at > F.col("_requeued")).select("job_id", F.lit(1).alias("n"))
    since = later.unionByName(same).groupBy("job_id").agg(F.sum("n").alias("_since"))
    tries = F.when(F.col("_requeued").isNull(), F.col("_claims")).otherwise(F.coalesce("_since", F.lit(0)))
    status = (
        F.when(F.col("_last") == "claim", "running")
        .when(F.col("_last") == "complete", "succeeded")
        .when((F.col("_last") == "fail") & (tries >= max_attempts), "dead")
        .otherwise("queued")
    )
    return state.join(since, "job_id", "left").select(
        "job_id", status.alias("status"), tries.alias("attempts"), "progress", "note", "events"
    )


# ---- rows that follow from a finished job --------------------------------


def payload_checks(jobs: DataFrame, payload: str = "payload", prompt: str = "$.prompt", messages: str = "$.messages") -> DataFrame:
    """Adds why a payload can never be processed: neither a prompt nor a message array.

    A prompt that is absent, null, false, zero or the empty string is missing;
    the string "0" is a prompt, so the JSON type decides.
    """
    value = F.col(payload)
    if dict(jobs.dtypes)[payload] == "string":
        value = F.try_parse_json(value)
    kind = F.schema_of_variant(F.try_variant_get(value, prompt, "variant"))
    text = F.try_variant_get(value, prompt, "string")
    given = (
        F.when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, prompt, "double") != 0)
        .otherwise(kind.rlike("^(OBJECT|ARRAY)"))
    )
    listed = F.schema_of_variant(F.try_variant_get(value, messages, "variant")).startswith("ARRAY")
    usable = F.coalesce(given, F.lit(False)) | F.coalesce(listed, F.lit(False))
    return jobs.withColumn("invalid_reason", F.when(~usable, "Job payload has no prompt"))


def charge_rows(jobs: DataFrame, ledger_job_ids: DataFrame | None = None) -> DataFrame:
    """Ledger rows for succeeded analysis jobs that belong to a contract.

    Jobs already charged are left out, so a second run books nothing twice.
    """
    done = jobs.filter(
        (F.col("status") == "succeeded") & F.col("kind").isin("analysis", "reanalysis") & F.col("contract_id").isNotNull()
    )
    if ledger_job_ids is not None:
        done = done.join(ledger_job_ids.select(F.col("job_id").alias("id")), "id", "left_anti")
    return done.select(
        F.col("id").alias("job_id"), "account_id", "contract_id", F.lit("analysis").alias("kind"), F.lit(10).alias("credits")
    )


def latest_analysis(analyses: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """The current analysis of each contract."""
    return newest_per_key(in_scope(analyses, scope), ["contract_id"], ["created_at", "id"])


def telemetry_rows(jobs: DataFrame, calls: DataFrame) -> DataFrame:
    """Telemetry to append for finished calls.

    ``calls`` has (id, job_id, created_at, duration_ms, tokens_in, tokens_out,
    ok, status, worker).  A failed call gets a short row: operation, outcome,
    error class and worker only.
    """
    owner = queue_wait(jobs).select(F.col("id").alias("job_id"), "account_id", F.col("kind").alias("op"), "queue_wait_ms")
    ok = F.coalesce("ok", F.lit(False))

    def when_ok(name: str) -> Column:
        return F.when(ok, F.col(name)).alias(name)

    return calls.join(owner, "job_id").select(
        "id",
        "account_id",
        "op",
        when_ok("duration_ms"),
        when_ok("tokens_in"),
        when_ok("tokens_out"),
        when_ok("queue_wait_ms"),
        ok.alias("ok"),
        F.when(~ok, F.coalesce(F.col("status").cast("string"), F.lit("error"))).alias("error_class"),
        "worker",
        "created_at",
    )
