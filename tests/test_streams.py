"""Streams in several micro-batches against their batch twins."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pactframe.operators import jobs
from pactframe.session import new_folder, shared_dir
from pactframe.sources.tables import append_table
from pactframe.streaming import streams
from pactframe.streaming.runner import drain, drain_batches
from tests.conftest import rows
from tests.test_jobs import CALLS, busy_calls, naive_streaks


@pytest.fixture
def in_files(spark):
    """Rows as a stream that reads one file per micro-batch, in the given order."""

    def make(parts):
        folder = new_folder(spark, "test-stream")
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def run_streaks(spark, stream, lateness="10 minutes"):
    step = streams.StreakBatches(new_folder(spark, "streaks"), lateness=lateness)
    drain_batches(stream, "streaks", step)
    step.finish(spark)
    return step.folder


@pytest.mark.parametrize("shuffled", [False, True])
def test_streaks_over_batches(spark, frame, in_files, shuffled):
    calls = sorted(busy_calls(240), key=lambda c: (c[1], c[2]))
    arriving = random.Random(4).sample(calls, len(calls)) if shuffled else calls
    folder = run_streaks(spark, in_files([frame(arriving[i : i + 60], CALLS) for i in range(0, 240, 60)]), "1000 days")
    assert {r.id: (r.streak, r.opened) for r in spark.read.parquet(f"{folder}/out").collect()} == naive_streaks(calls)


def test_a_late_success_breaks_the_streak(spark, frame, in_files):
    def call(n, second, ok):
        return ("w", f"2024-01-01 00:00:{second:02d}", n, ok, not ok)

    first = [call(n, n, False) for n in (0, 1, 3, 4)]
    folder = run_streaks(spark, in_files([frame(first, CALLS), frame([call(2, 2, True)], CALLS)]))
    assert {r.id: r.streak for r in spark.read.parquet(f"{folder}/out").collect()} == {0: 1, 1: 2, 3: 1, 4: 2}


def test_calls_beyond_the_bound_are_kept_apart(spark, frame, in_files):
    parts = [[("w", "2024-01-01 10:00:00", 1, False, True)], [("w", "2024-01-01 08:00:00", 2, True, False), ("w", "2024-01-01 10:01:00", 3, False, True)]]
    folder = run_streaks(spark, in_files([frame(p, CALLS) for p in parts]))
    assert {r.id: r.streak for r in spark.read.parquet(f"{folder}/out").collect()} == {1: 1, 3: 2}
    assert [r.id for r in streams.StreakBatches(folder).late(spark).collect()] == [2]


def test_job_state_over_batches(spark, in_files):
    events = spark.range(400).select(
        F.col("id").alias("seq"), F.concat(F.lit("job-"), (F.col("id") * 7 % 11).cast("string")).alias("job_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 37 % 400).cast("int"))).alias("ts"),
        F.element_at(F.array(*map(F.lit, ["progress", "claim", "complete", "requeue", "fail"])), (F.col("id") * 13 % 23 % 5 + 1).cast("int")).alias("action"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 150).cast("int")).alias("progress"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("note"))
    # events of one job arrive out of order and in different batches
    step = streams.JobStateBatches(new_folder(spark, "jobs"))
    drain_batches(in_files([events.filter(f"seq % 3 = {i}") for i in range(3)]), "jobs", step)
    twin = rows(jobs.job_state_fold(events), "job_id")
    columns = jobs.job_state_fold(events).columns
    # a restarted process knows no more than the folder
    step = streams.JobStateBatches(step.folder)
    assert rows(step.states(spark).select(*columns), "job_id") == twin
    step.fold(spark)
    assert rows(step.states(spark).select(*columns), "job_id") == twin
    assert spark.read.parquet(f"{step.folder}/folded-claims").count() < events.filter("action = 'claim'").count()
    # a batch repeated after the fold, and one after it
    step(events.filter("seq % 3 = 2"), 2)
    more = events.filter("seq < 40").withColumn("seq", F.col("seq") + 1000)
    step(more, 3)
    assert rows(step.states(spark).select(*columns), "job_id") == rows(jobs.job_state_fold(events.unionByName(more)), "job_id")


def test_a_batch_of_job_events_reads_nothing_of_earlier_ones(spark, frame):
    ddl = "job_id string, seq long, ts timestamp, action string, progress int, note string"
    folder = new_folder(spark, "jobs")
    step = streams.JobStateBatches(folder)
    for n in range(3):
        step(frame([(f"j{n}", n, "2024-01-01 00:00:00", "claim", None, None)], ddl), n)
        part = spark.read.parquet(f"{folder}/state/batch={n}")
        assert [r.job_id for r in part.collect()] == [f"j{n}"]
    assert step.states(spark).count() == 3


def test_streaks_go_on_after_a_restart(spark, frame, in_files):
    calls = sorted(busy_calls(120), key=lambda c: (c[1], c[2]))
    folder = new_folder(spark, "streaks")
    for n in range(4):
        # a new object for each batch, and a batch that is repeated
        streams.StreakBatches(folder)(frame(calls[n * 30 : n * 30 + 30], CALLS), n)
        if n == 2:
            streams.StreakBatches(folder)(frame(calls[60:90], CALLS), 2)
    streams.StreakBatches(folder).finish(spark)
    assert {r.id: (r.streak, r.opened) for r in spark.read.parquet(f"{folder}/out").collect()} == naive_streaks(calls)


def test_alerts_only_for_jobs_that_did_not_end(frame, in_files):
    ddl = "id long, at timestamp, status string"
    first = [(1, "2024-01-01 00:00:00", "running"), (1, "2024-01-01 00:04:00", "running"), (2, "2024-01-01 00:00:00", "running"), (4, "2024-01-01 00:00:00", "running")]
    later = [(1, "2024-01-01 00:08:00", "running"), (3, "2024-01-01 01:00:00", "running"), (4, "2024-01-01 00:03:00", "succeeded")]
    stream = in_files([frame(first, ddl), frame(later, ddl)])
    found = rows(drain(streams.stream_stale_jobs(stream), "beats").select("id", F.date_format("last_heartbeat", "HH:mm")), "id")
    # the newest heartbeat of all is not old enough yet
    assert found == [(1, "00:08"), (2, "00:00")]


@pytest.mark.parametrize("cut", [1, 2, 4])
def test_repeats_after_hours_in_any_batching(spark, frame, in_files, cut):
    ddl = "id long, user_id string, account_id string, kind string, idempotency_key string, requested_at timestamp"
    keys = [("a", "k", 0), ("a", None, 1), ("b", "k", 2), ("a", "k", 3), ("a", None, 4), ("a", "live", 5), ("b", "x", 6), ("b", "k", 9)]
    asked = [(n, "u", account, "ocr", key, f"2024-01-01 {hour:02d}:00:00") for n, (account, key, hour) in enumerate(keys)]
    live = frame([("a", "live", "running"), ("b", "x", "dead")], "account_id string, idempotency_key string, status string")
    accounts = frame([("a", "scale"), ("b", "growth")], "account_id string, plan string")
    members = frame([("u", "a", "owner"), ("u", "b", "member")], "user_id string, account_id string, role string")
    folder = new_folder(spark, "enqueue")
    stream = in_files([frame(asked[i : i + cut], ddl) for i in range(0, len(asked), cut)])
    drain_batches(stream, "enqueue", streams.EnqueueBatches(folder, live, accounts, members))
    queued = spark.read.parquet(f"{folder}/out").filter("outcome = 'queued'")
    assert sorted(r.id for r in queued.collect()) == [0, 1, 2, 4, 6]


def test_append_by_day(spark, frame):
    path = new_folder(spark, "telemetry")
    data = frame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id int, created_at timestamp")
    append_table(data, path)
    append_table(data, path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.filter("day = '2024-01-02'").count() == 2


def session_like(folder, master):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder_comes_from_the_session():
    assert shared_dir(session_like("/shared", "yarn")) == "/shared"
    assert new_folder(session_like("/shared", "yarn"), "x").startswith("/shared/x-")
    assert shared_dir(session_like(None, "local[2]")) == shared_dir(session_like(None, "local[2]"))
    with pytest.raises(ValueError):
        shared_dir(session_like(None, "yarn"))


def test_daily_sink_repeats_and_compacts(spark, frame):
    ddl = "id long, created_at timestamp, op string"
    def made(ids):
        return frame([(i, None if i % 10 == 9 else f"2024-01-{1 + i % 3:02d} 10:00:00", f"op{i}") for i in ids], ddl)

    sink = streams.DailySink(new_folder(spark, "sink"))
    schema = made([]).schema
    assert sink.read(spark, schema).count() == 0 and sink.compact(spark, schema) == []

    def ids(upto):
        found = sink.read(spark, schema)
        assert all(str(r.day) == str(r.created_at)[:10] if r.created_at else r.day is None for r in found.collect())
        return sorted(r.id for r in found.collect()) == list(range(upto))

    for n in range(3):
        sink(made(range(n * 20, n * 20 + 20)), n)
        sink(made(range(n * 20, n * 20 + 20)), n)
    assert ids(60)
    assert sink.compact(spark, schema) == ["2024-01-01", "2024-01-02", "2024-01-03", "none"]
    assert ids(60) and sink.compact(spark, schema) == []
    # the last batch comes again after it was compacted, then one with rows of a single day
    sink(made(range(40, 60)), 2)
    sink(made([60]), 3)
    sink(frame([(61, "2024-01-01 11:00:00", "x")], ddl), 4)
    assert ids(62)
    assert sink.compact(spark, schema) == ["2024-01-01"] and ids(62)


def test_a_failed_compaction_changes_nothing(spark, frame):
    ddl = "id long, created_at timestamp"
    sink = streams.DailySink(new_folder(spark, "sink"))
    parts = [frame([(n, "2024-01-01 10:00:00")], ddl) for n in range(2)]
    for n, part in enumerate(parts):
        sink(part, n)
    # written but not published
    parts[0].withColumn("day", F.lit("2024-01-01")).write.partitionBy("day").parquet(f"{sink.folder}/compacted/upto=1")
    assert sorted(r.id for r in sink.read(spark, parts[0].schema).collect()) == [0, 1]
    sink.compact(spark, parts[0].schema)
    assert sorted(r.id for r in sink.read(spark, parts[0].schema).collect()) == [0, 1]


SIGNS = "id string, at timestamp, status string"


def sign(job, second, status="running"):
    return (job, f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}", status)


def alerts_by_batch(spark, stream, **options):
    """(micro-batch, job, last sign) of every alert, with the times as HH:mm."""
    found = []

    def step(batch, number):
        found.extend((number, r.id, r.at) for r in batch.select("id", F.date_format("last_heartbeat", "HH:mm").alias("at")).collect())

    drain_batches(streams.stream_stale_timers(stream, **options), "timers", step)
    return sorted(found)


def naive_alerts(signs, until, gap=300):
    """(job, first sign, last sign) of every span that ends without the end of its job, by a plain walk."""
    out, by_job = [], {}
    for job, second, status in signs:
        by_job.setdefault(job, {}).setdefault(second, []).append(status)
    for job, at in by_job.items():
        start = None
        for n, second in enumerate(times := sorted(at)):
            start = second if start is None else start
            if n + 1 < len(times) and times[n + 1] - second <= gap:
                continue
            if set(at[second]) == {"running"} and second + gap < until:
                out.append((job, start, second))
            start = None
    return sorted(out)


@pytest.mark.parametrize("files", [1, 3, 7])
def test_timers_in_any_batching(spark, frame, in_files, files):
    dice = random.Random(8)
    # a third of all signs are of one job; the last one, of a job of its own, moves the watermark on
    signs = [("hot" if n % 3 == 0 else f"j{n % 40}", dice.randrange(40) * 300 + dice.choice([0, 0, 1, 299]), dice.choice(["running"] * 4 + ["dead"])) for n in range(400)]
    arriving = dice.sample(signs, len(signs))
    parts = [[sign(*s) for s in arriving[i::files]] for i in range(files)] + [[sign("last", 80_000)]]
    found = drain(streams.stream_stale_timers(in_files([frame(p, SIGNS) for p in parts]), lateness="15000 seconds"), "timers")
    seconds = [F.unix_timestamp(c) - F.lit(1704067200) for c in ("alive_since", "last_heartbeat")]
    assert rows(found.select("id", *seconds), "id", "last_heartbeat") == naive_alerts(signs, 65_000)
    assert found.where("stale_at != last_heartbeat + interval 5 minutes").count() == 0


def test_timer_is_set_anew_taken_away_and_runs_out_without_news(spark, frame, in_files):
    parts = [
        [sign("lost", 0), sign("late", 0), sign("done", 0), sign("clock", 0)],
        [sign("late", 480), sign("late", 240), sign("done", 200, "succeeded"), sign("clock", 600), sign(None, 0), ("lost", None, "running")],
        [sign("clock", 901)],
        [sign("clock", 1100), sign("clock", 1400)],
    ]
    found = alerts_by_batch(spark, in_files([frame(p, SIGNS) for p in parts]), lateness="10 minutes")
    # the watermark is 05:01 after the third file and 13:20 after the fourth; "clock" missed 00:00 to 10:00 and 10:00 to 15:01
    at = {(job, last): number for number, job, last in found}
    assert set(at) == {("lost", "00:00"), ("clock", "00:00"), ("late", "00:08")}
    assert at["lost", "00:00"] == at["clock", "00:00"] < at["late", "00:08"]


def test_timers_go_on_after_a_restart(spark, frame):
    source, out, checkpoint = (new_folder(spark, n) for n in ("signs", "alerts", "alerts-checkpoint"))
    for part in ([sign("a", 0), sign("b", 0)], [sign("a", 250), sign("c", 880)], [sign("c", 2000)]):
        data = frame(part, SIGNS)
        data.coalesce(1).write.mode("append").parquet(source)
        alerts = streams.stream_stale_timers(spark.readStream.schema(data.schema).parquet(source))
        query = alerts.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
    found = spark.read.schema(alerts.schema).parquet(out)
    assert [(r.id, r.last_heartbeat.minute) for r in found.orderBy("id", "last_heartbeat").collect()] == [("a", 4), ("b", 0), ("c", 14)]


def test_timers_are_kept_without_python_per_job(frame, in_files):
    alerts = streams.stream_stale_timers(in_files([frame([sign("a", 0)], SIGNS)]), lateness="10 minutes")
    plan = alerts._jdf.queryExecution().analyzed().toString()
    assert "InPandas" not in plan and "Python" not in plan
    assert [(f.name, f.dataType.simpleString()) for f in alerts.schema][1:] == [("alive_since", "timestamp"), ("last_heartbeat", "timestamp"), ("stale_at", "timestamp")]
