import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pactframe.functions.columns import half_up, percent, title_case
from pactframe.operators import accounts, accuracy, metering
from tests.conftest import rows

ACCOUNTS = "account_id string, plan string, credits_included int, credits_banked int, period_started_at timestamp"
LEDGER = "id long, account_id string, kind string, credits int, created_at timestamp"


def test_credits_remaining(frame):
    start = "2024-01-10 00:00:00"
    owned = frame(
        [("none", "growth", 100, 5, start), ("open", "growth", 100, None, None), ("top", "growth", None, None, start),
         ("over", "growth", 10, 0, start), ("edge", "growth", 50, 0, start)], ACCOUNTS)
    ledger = frame(
        [(1, "open", "analysis", 30, start), (2, "top", "topup", -40, start), (3, "over", "analysis", 30, start),
         (4, "edge", "analysis", 10, start), (5, "edge", "analysis", 10, "2024-01-09 23:59:59"), (6, "unknown", "analysis", 10, start)],
        LEDGER)
    found = dict(rows(metering.credits_remaining(owned, ledger)))
    # no period start means nothing counts as spent; the instant of the start counts
    assert found == {"none": 105, "open": 100, "top": 40, "over": 0, "edge": 40}


def test_period_roll_banks_up_to_the_cap(spark, frame):
    owned = frame([("a", "scale", 5000, 0, None), ("b", "scale", 100, 20, None), ("c", "growth", 500, 0, None)], ACCOUNTS)
    rolled = metering.roll_billing_period(
        owned, frame([], LEDGER), accounts.plan_catalog(spark), F.lit("2024-02-01").cast("timestamp"))
    assert dict(rows(rolled.select("account_id", "credits_banked"))) == {"a": 1800, "b": 120, "c": 300}


def test_call_budget_and_cost(frame):
    calls = frame([("a", "2024-01-01 10:00:00")] * 3 + [("a", "2024-01-01 11:00:00")], "account_id string, created_at timestamp")
    assert sorted(r[2:] for r in rows(metering.hourly_call_budget(calls, cap=2))) == [(1, 1, 0), (3, 2, 1)]
    t = frame([("a", "x", 1000, None), ("a", "x", None, 100)], "account_id string, op string, tokens_in int, tokens_out int")
    assert rows(metering.token_cost(t)) == [("a", "x", 2, 1000, 100, pytest.approx(0.0045))]


def test_half_up(frame):
    values = frame([(1, 8), (3, 8), (-1, 8), (5, 0), (0, 3)], "a long, b long")
    assert [r[0] for r in values.select(half_up(F.col("a"), F.col("b"), 2)).collect()] == [0.13, 0.38, -0.13, None, 0.0]
    assert values.limit(1).select(percent(F.col("a"), F.col("b"))).first()[0] == 12.5


def test_tiers_and_accuracy(frame):
    points = frame(
        [(i, c, None if c == 100 else i % 8 == 0) for i, c in enumerate([0, 50, 51, 80, 81, 100])], "id int, confidence int, was_correct boolean")
    tiered = accuracy.tiered_points(points)
    assert [r.tier for r in tiered.orderBy("id").collect()] == ["deep", "deep", "light", "light", "auto", "auto"]
    found = {r[0]: r[1:] for r in rows(accuracy.accuracy_by_tier(tiered))}
    assert found == {"deep": (2, 50.0, 25.0), "light": (2, 0.0, 65.5), "auto": (1, 0.0, 81.0)}


def test_audit_replay(frame):
    points = frame([(1, "pending"), (2, "accepted"), (3, "rejected")], "id long, status string")
    audit = frame(
        [(1, 1, "u", "corrected", "old", "2024-01-01"), (2, 1, "w", "reopened", None, "2024-01-02"), (3, 2, "u", "accepted", None, "2024-01-02"),
         (4, 2, "v", "corrected", "new", "2024-01-02")],
        "id long, data_point_id long, user_id string, action string, value_after string, created_at timestamp")
    state = accuracy.verification_state(points, audit).select("data_point_id", "status", "verified_by", "corrected_value", "reopened_by")
    assert rows(state, "data_point_id") == [
        (1, "pending", None, None, "w"), (2, "corrected", "v", "new", None), (3, "rejected", None, None, None)]


def test_title_case(frame):
    names = frame([("acme-corp ltd.",), ("ÉCLAIR o'neil",), (None,)], "n string")
    assert [r[0] for r in names.select(title_case(F.col("n"))).collect()] == ["Acme-Corp Ltd.", "Éclair O'Neil", None]


def test_accounts_may_call_their_key_id(frame):
    owned = frame([("a", 100, 0, "2024-01-01")], "id string, credits_included int, credits_banked int, period_started_at timestamp")
    ledger = frame([(1, "a", "analysis", 30, "2024-01-02")], LEDGER)
    assert rows(metering.credits_remaining(owned, ledger)) == [("a", 70)]


def plain_windows(calls, length):
    out = {}
    for account, at in sorted((a, dt.datetime.fromisoformat(t)) for a, t in calls if a and t):
        mine = out.setdefault(account, [])
        if not mine or at - mine[-1][0] > length:
            mine.append([at, 0, at])
        mine[-1][1:] = [mine[-1][1] + 1, at]
    return sorted((a, str(s), n, str(s), str(e)) for a, ws in out.items() for s, n, e in ws)


@pytest.mark.parametrize("minutes, span", [(60, 3000), (7, 400), (60, 10)])
def test_anchored_windows_match_a_plain_loop(frame, minutes, span):
    """One account has most calls, many at the same instants, and windows open exactly at their end as well."""
    pick = random.Random(minutes)
    calls = [("hot" if pick.random() < 0.7 else f"a{pick.randrange(8)}", str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=pick.randrange(span)))) for _ in range(1500)]
    calls += [(None, "2024-01-01 00:00:00"), ("a1", None), ("one", "2024-01-01 00:00:00")]
    found = metering.anchored_windows(frame(calls, "account_id string, created_at timestamp"), f"{minutes} minutes").collect()
    assert sorted((r.account_id, str(r.window_start), r.calls, str(r.first_call), str(r.last_call)) for r in found) == plain_windows(calls, dt.timedelta(minutes=minutes))


def test_refused_calls_follow_the_first_call(frame):
    calls = frame([("a", f"2024-01-01 {t}:00") for t in ("10:50", "11:10", "11:50", "11:51")], "account_id string, created_at timestamp")
    assert sorted(r[2:] for r in rows(metering.anchored_call_budget(calls, cap=2))) == [(1, 1, 0), (3, 2, 1)]
    assert rows(metering.anchored_call_budget(frame([], "account_id string, created_at timestamp"))) == []
