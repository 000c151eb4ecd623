import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pactframe.operators import jobs, ops
from tests.conftest import rows

NOW = "2024-01-20 00:00:00"
T0 = dt.datetime(2024, 1, 20)
CONTRACTS = "id string, ref string, supplier string"


def test_stale_jobs(frame):
    ddl = "id int, account_id string, status string, attempts int, max_attempts int, heartbeat_at timestamp, error string"
    data = frame(
        [(1, "a", "running", 1, 5, None, None), (2, "a", "running", 1, 5, "2024-01-19 23:55:00", None),
         (3, "a", "running", 5, 5, "2024-01-19 23:54:59", None), (4, "a", "running", 6, 9, "2024-01-19 23:00:00", "old"),
         (5, "a", "running", 7, 9, "2024-01-19 23:00:00", None), (6, "a", "queued", 0, 5, "2024-01-19 23:00:00", None)], ddl)
    found = {r.id: (r.status, (r.run_after - T0).total_seconds(), r.error) for r in jobs.stale_jobs(data, NOW).collect()}
    assert found == {3: ("dead", 320, "worker heartbeat lost"), 4: ("queued", 640, "old"), 5: ("queued", 640, "worker heartbeat lost")}


def test_failures(frame):
    data = frame([(i, n, 5, "2024-01-01") for i, n in enumerate([1, 4, 5, 1])], "id int, attempts int, max_attempts int, run_after timestamp")
    failed = frame([(0, "e", True), (1, "e", True), (2, "e", True), (3, "e", False), (99, "e", True)], "id int, error string, retryable boolean")
    found = {r.id: (r.status, (r.run_after - T0).total_seconds() if r.status == "queued" else None, r.finished_at)
             for r in jobs.apply_failures(data, failed, NOW).collect()}
    assert found == {0: ("queued", 20, None), 1: ("queued", 160, None), 2: ("dead", None, T0), 3: ("dead", None, T0)}


def test_progress(frame):
    data = frame([(i, "old") for i in range(5)], "id int, progress_note string")
    reports = frame([(0, -5, "n"), (1, 0, None), (2, 100, None), (3, 250, None), (4, None, None)], "id int, progress int, note string")
    found = rows(jobs.apply_progress(data, reports, NOW).select("id", "progress", "progress_note"), "id")
    assert found == [(0, 0, "n"), (1, 0, "old"), (2, 100, "old"), (3, 100, "old"), (4, 100, "old")]


def test_enqueue(frame):
    members = frame([("e", "a", "member"), ("v", "a", "viewer")], "user_id string, account_id string, role string")
    accounts = frame([("a", "scale")], "account_id string, plan string")
    live = frame([("a", "live", "running"), ("a", "done", "succeeded"), ("a", "gone", "dead")], "account_id string, idempotency_key string, status string")
    asked = frame(
        [(1, "e", "a", "new", "2024-01-01"), (2, "e", "a", "new", "2024-01-02"), (3, "e", "a", "live", "2024-01-01"),
         (4, "e", "a", "done", "2024-01-01"), (5, "e", "a", "gone", "2024-01-01"), (6, "e", "a", None, "2024-01-01"),
         (7, "e", "a", None, "2024-01-01"), (8, "v", "a", "new", "2023-01-01"), (9, "x", "a", None, "2024-01-01")],
        "id int, user_id string, account_id string, idempotency_key string, requested_at timestamp")
    made, repeats = jobs.enqueue_batch(asked, live, accounts, members)
    assert rows(made.select("id", "priority"), "id") == [(1, 30), (5, 30), (6, 30), (7, 30)]
    assert rows(repeats.select("id", "outcome"), "id") == [(2, "collapsed"), (3, "existing"), (4, "existing")]


def test_error_classes(frame):
    errors = frame(
        [(408, None, False), (429, None, False), (499, None, False), (500, None, False), (400, "Timeout hit", False),
         (None, "bad", None), (None, "econnreset", None), (500, "", True)], "status int, message string, fatal boolean")
    assert [r.retryable for r in jobs.classify_errors(errors).collect()] == [True, True, False, True, True, False, True, False]
    texts = frame([(400, " no prompt "), (None, "x" * 600), (None, "\n y \t")], "status int, message string")
    assert rows(jobs.error_text(texts).select("error", "error_class")) == [("400  no prompt", "400"), ("x" * 600, "error"), ("y", "error")]
    assert rows(jobs.error_text(texts, max_chars=500).select("error")) == [("400  no prompt",), ("x" * 500,), ("y",)]


def naive_streaks(calls, threshold=4):
    """One worker after another, one call after another."""
    out, count = {}, {}
    for worker, at, i, ok, retryable in sorted(calls, key=lambda c: (c[0], c[1], c[2])):
        if ok:
            count[worker] = 0
        elif ok is not None and retryable:
            count[worker] = count.get(worker, 0) + 1
            out[i] = (count[worker], count[worker] >= threshold)
    return out


def busy_calls(n=600, seed=5):
    pick = random.Random(seed)
    # worker 0 has most of the log, and some instants repeat
    return [
        (f"w{0 if pick.random() < 0.7 else pick.randrange(3)}",
         str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=pick.randrange(3000))), i,
         pick.choice([True, False, False, False, None]), pick.random() < 0.8)
        for i in range(n)
    ]


CALLS = "worker string, created_at timestamp, id long, ok boolean, retryable boolean"


@pytest.mark.parametrize("levels", [("minute",), ("second", "hour"), ("minute", "hour", "day")])
def test_streaks_match_a_plain_loop(frame, levels):
    calls = busy_calls()
    found = {r.id: (r.streak, r.opened) for r in jobs.failure_streaks(frame(calls, CALLS), levels=levels).collect()}
    assert found == naive_streaks(calls)


def test_streak_rules(frame):
    calls = [("w", f"2024-01-01 00:0{i}:00", i, ok, r) for i, (ok, r) in enumerate(
        [(False, True), (False, True), (False, False), (False, True), (False, True), (False, True), (True, None), (False, True)])]
    found = rows(jobs.failure_streaks(frame(calls, CALLS)).select("id", "streak", "opened", "open_until"), "id")
    assert [f[:3] for f in found] == [(0, 1, False), (1, 2, False), (3, 3, False), (4, 4, True), (5, 5, True), (7, 1, False)]
    assert found[4][3] == dt.datetime(2024, 1, 1, 0, 6)


def test_job_fold(frame):
    events = frame(
        [(1, 1, "2024-01-01", "claim", None, "a"), (2, 1, "2024-01-02", "fail", None, None), (3, 1, "2024-01-03", "requeue", None, None),
         (4, 1, "2024-01-04", "claim", None, None), (5, 1, "2024-01-04", "progress", None, None),
         *[(10 + i, 2, f"2024-01-0{i + 1}", "claim", None, None) for i in range(5)], (20, 2, "2024-01-08", "fail", None, "n"),
         (30, 3, "2024-01-01", "progress", 40, None)],
        "seq long, job_id long, ts timestamp, action string, progress int, note string")
    found = rows(jobs.job_state_fold(events), "job_id")
    assert found == [(1, "running", 1, 100, "a", 5), (2, "dead", 5, 0, "n", 6), (3, "queued", 0, 40, None, 1)]


def test_recent_jobs_and_depth(frame):
    data = frame(
        [(1, "c1", "k", "queued", "2024-01-19 00:00:00"), (2, "c2", "k", "queued", "2024-01-19 00:00:00.5"),
         (3, "gone", "k", "running", None), (4, "gone", "k", "queued", "2024-01-19 23:00:00")],
        "id int, contract_id string, kind string, status string, enqueued_at timestamp")
    contracts = frame([("c1", "R", "S"), ("c2", "R2", "S2")], CONTRACTS)
    found = rows(jobs.recent_jobs(data, contracts, NOW).select("id", "ref", "age_seconds"), "id")
    assert found == [(2, "R2", 86400), (4, None, 3600)]
    depth = {r.status: (r.n, r.oldest_seconds) for r in jobs.queue_depth(data, NOW).collect()}
    assert depth == {"queued": (3, 86400.0), "running": (1, None)}


def test_claim_order(frame):
    data = frame(
        [(3, "a", "x", "queued", 10, NOW), (1, "a", "x", "queued", 10, NOW), (2, "a", "y", "queued", 5, "2024-01-20 00:00:01"),
         (4, "b", "y", "queued", 50, "2024-01-01")], "id int, account_id string, kind string, status string, priority int, run_after timestamp")
    assert [r.id for r in jobs.claimable_jobs(data, NOW, n=5).collect()] == [1, 3, 4]
    assert [r.id for r in jobs.claimable_jobs(data, NOW, ["y"]).collect()] == [4]
    assert rows(jobs.claimable_per_account(data, NOW, 1).select("id"), "id") == [(1,), (4,)]


def test_payloads(frame):
    texts = ['{"prompt":"x"}', '{"prompt":""}', '{"prompt":0}', '{"prompt":"0"}', '{"prompt":null}', '{"messages":[]}',
             '{"messages":"x"}', "{}", None, '{"prompt":false}', '{"prompt":{}}', '{"prompt":2.5}', "not json"]
    data = frame([(i, t) for i, t in enumerate(texts)], "id int, payload string")
    bad = [r.id for r in jobs.payload_checks(data).filter("invalid_reason is not null").orderBy("id").collect()]
    assert bad == [1, 2, 4, 6, 7, 8, 9, 12]


def test_health(frame):
    data = frame(
        [(1, "x", None, None, None, False, "2024-01-19 10:00:01"), (2, "x", None, 5, None, None, "2024-01-19 10:00:02"),
         (3, "y", 10, 1, 2, True, "2024-01-19 10:00:00"), (4, "y", 15, 1, None, True, "2024-01-19 10:00:00"),
         (5, "y", 1, 1, 1, True, "2024-01-19 00:00:00")],
        "id int, op string, duration_ms int, tokens_in int, tokens_out int, ok boolean, created_at timestamp")
    found = {r.op: tuple(r)[2:] for r in ops.ops_health(data, NOW).collect()}
    assert found == {"x": (2, None, None, 0.0, None), "y": (2, 13.0, 15, 100.0, 3)}


def plain_spans(calls, threshold, hold):
    """(worker, opened, closed, failures) by walking through each worker's log."""
    out, streak, spans = [], {}, {}
    for worker, at, i, ok, retryable in sorted(calls, key=lambda c: (dt.datetime.fromisoformat(c[1]), c[2])):
        at, open_now = dt.datetime.fromisoformat(at), spans.get(worker)
        if ok:
            streak[worker] = 0
            if open_now and at < open_now[1]:
                open_now[1] = at
        elif ok is False and retryable:
            streak[worker] = streak.get(worker, 0) + 1
            if streak[worker] >= threshold:
                if open_now and at <= open_now[1]:
                    open_now[1], open_now[2] = at + hold, open_now[2] + 1
                else:
                    spans[worker] = [at, at + hold, 1, at]
                    out.append((worker, spans[worker]))
    return sorted((w, str(s[0]), str(s[1]), s[2]) for w, s in out)


@pytest.mark.parametrize("threshold, minutes", [(1, 1), (2, 30), (2, 1000), (4, 10)])
def test_breaker_spans_match_a_plain_loop(frame, threshold, minutes):
    calls = busy_calls(900, 11)
    found = jobs.breaker_spans(frame(calls, CALLS), threshold, f"{minutes} minutes").collect()
    assert sorted((r.worker, str(r.opened_at), str(r.closed_at), r.failures) for r in found) == plain_spans(calls, threshold, dt.timedelta(minutes=minutes))
    assert all(r.seconds_open == (r.closed_at - r.opened_at).total_seconds() for r in found)


def test_a_success_closes_the_breaker_at_once(frame):
    calls = [("w", f"2024-01-01 00:00:{s:02d}", n, ok, True) for n, (s, ok) in enumerate([(0, False), (10, False), (20, True), (25, False), (26, False)])]
    found = rows(jobs.breaker_spans(frame(calls, CALLS), 2), "opened_at")
    assert [(str(r[1])[-8:], str(r[2])[-8:], r[3], r[4]) for r in found] == [("00:00:10", "00:00:20", 1, 10.0), ("00:00:26", "00:01:26", 1, 60.0)]
    assert rows(jobs.breaker_spans(frame([], CALLS))) == []
