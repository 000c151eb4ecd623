import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pactframe.operators import obligations, policy, quality
from pactframe.operators.asof import asof_join, running_sum
from pactframe.operators.quality import Check, Reference, Unique
from tests.conftest import rows

PACKS = "id long, account_id string, jurisdiction string, active boolean, effective_from timestamp, effective_to timestamp"


@pytest.mark.parametrize("bucket", ["minute", "hour", "day"])
def test_asof_join_matches_a_plain_loop(frame, bucket):
    pick = random.Random(3)
    stamp = lambda: f"2024-0{pick.randrange(1, 4)}-{pick.randrange(1, 28):02d} {pick.randrange(24):02d}:00:00"
    key = lambda: "hot" if pick.random() < 0.6 else pick.choice(["a", "b"])
    probes = [(i, key(), stamp() if i % 20 else None) for i in range(300)]
    events = [(i, key(), stamp()) for i in range(120)] + [(999, "z", "2024-01-01 00:00:00")]
    expected = {}
    for i, k, at in probes:
        best = max(((e_at, e) for e, e_k, e_at in events if at is not None and e_k == k and e_at <= at), default=(None, None))
        expected[i] = best[1]
    found = asof_join(frame(probes, "id int, k string, at timestamp"), frame(events, "event int, k string, t timestamp"), ["k"], "at", "t", ["event"], bucket)
    assert {r.id: r.event for r in found.collect()} == expected


def test_running_sum_across_buckets(frame):
    steps = frame([("a", "2024-01-01", 1), ("a", "2024-01-01", 2), ("a", "2024-03-05", 4), ("b", "2024-02-01", 8)], "k string, at timestamp, n int")
    found = rows(running_sum(steps, ["k"], "at", ["n"]).select("k", "n"), "k", "n")
    assert found == [("a", 3), ("a", 7), ("b", 8)]


def test_packs_in_force(frame):
    packs = frame(
        [(1, None, "GB", True, "2024-01-10", None), (2, None, "ANY", True, "2024-01-01", "2024-01-10"), (3, None, "GB", True, None, None),
         (4, None, "GB", False, "2024-01-01", None), (5, "a", "GB", True, "2024-01-01", "2024-02-01"), (6, None, "EU", True, "2024-01-01", None)], PACKS)
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(policy.policy_packs_at(packs, "2024-01-10", "GB")) == [1, 5]
    assert ids(policy.policy_packs_at(packs, "2024-01-09", "GB")) == [2, 5]
    assert ids(policy.policy_packs_at(packs, "2024-01-10")) == [1, 5, 6]
    mine = frame([("b",)], "account_id string")
    assert ids(policy.policy_packs_at(packs, "2024-01-10", "GB", scope=mine)) == [1]
    graded = frame(
        [(1, "a", "GB", "2024-01-10"), (2, "a", "GB", "2024-01-09"), (3, "b", "GB", "2024-01-09"), (4, "b", "US", "2024-01-01"), (5, "a", "GB", "2023-01-01"),
         (6, "b", "CH", "2024-01-01"), (7, None, "ANY", "2024-01-01")],
        "analysis int, account_id string, jurisdiction string, at timestamp")
    found = rows(policy.policy_snapshot(graded, packs, "at").select("analysis", "global_packs", "own_packs", "pack_set"), "analysis")
    assert [r[:3] for r in found[:6]] == [(1, 1, 1), (2, 1, 1), (3, 1, 0), (4, 1, 0), (5, 0, 0), (6, 1, 0)]
    number = lambda n: int(hashlib.md5(str(n).encode()).hexdigest()[:9], 16)
    assert [r[3] for r in found[:6]] == [number(1) + number(5), number(2) + number(5), number(2), number(2), 0, number(2)]


def test_obligations(frame):
    due = frame(
        [(1, "c", "open", "1998-01-01", None), (2, "c", "open", None, "u"), (3, "c", "open", "1997-12-31", "u"),
         (4, "gone", "open", "1997-01-01", "u"), (5, "c", "done", "1997-01-01", "u")],
        "id int, contract_id string, status string, due_date date, assignee_id string")
    contracts = frame([("c", "R", "S")], "id string, ref string, supplier string")
    found = rows(obligations.obligations_due(due, contracts, "1998-01-01").select("id", "overdue", "unassigned"), "id")
    assert found == [(1, False, True), (2, None, False), (3, True, False)]


def test_constraint_reports(frame):
    tables = {
        "child": frame([(1, "p"), (2, "x"), (3, "x"), (4, None)], "id int, parent_id string"),
        "parent": frame([("p", 1), ("q", None), ("p", 2)], "id string, n int"),
    }
    references = [Reference("child", "parent_id", "parent"), Reference("child", "id", "parent", "n")]
    assert rows(quality.fk_orphans(tables, references), "reference") == [("child.id", "parent", 2, 2), ("child.parent_id", "parent", 1, 2)]
    found = quality.unique_violations(tables, [Unique("parent", ("id",)), Unique("child", ("parent_id",), "id > 2")])
    assert rows(found) == [("parent", "id", 1, 2), ("child", "parent_id", 0, 0)]
    found = quality.check_violations(tables, [Check("parent", "n", "n > 1"), Check("parent", "id", "id is not null")])
    assert rows(found) == [("parent", "n", 3, 1), ("parent", "id", 3, 0)]


def test_erasure_cascades(frame):
    tables = {
        "accounts": frame([("a",), ("b",)], "account_id string"),
        "contracts": frame([("ca", "a"), ("cb", "b")], "id string, account_id string"),
        "points": frame([(1, "ca"), (2, "cb"), (3, None)], "id int, contract_id string"),
        "audit": frame([(1, 1, "u"), (2, 2, "u"), (3, 3, "v")], "id int, data_point_id int, user_id string"),
    }
    references = [
        Reference("contracts", "account_id", "accounts", "account_id"), Reference("points", "contract_id", "contracts"),
        Reference("audit", "data_point_id", "points"),
    ]
    left = quality.erase_accounts(tables, frame([("a",)], "account_id string"), references)
    assert {n: sorted(r[0] for r in df.collect()) for n, df in left.items()} == {
        "accounts": ["b"], "contracts": ["cb"], "points": [2, 3], "audit": [2, 3]
    }
    unlinked = quality.unlink_users(tables["audit"], frame([("u",)], "id string"), ["user_id"])
    assert rows(unlinked, "id") == [(1, 1, None), (2, 2, None), (3, 3, "v")]
    two = frame([(1, "u", "v"), (2, "w", "u"), (3, None, "w")], "id int, a string, b string")
    assert rows(quality.unlink_users(two, frame([("u",), ("v",)], "id string"), ["a", "b"]), "id") == [(1, None, None), (2, "w", None), (3, None, "w")]


def test_consent(frame):
    docs = frame(
        [(1, "a", "k1", True, "2024-01-05"), (2, "a", None, True, "2024-01-01"), (3, "a", "k9", True, "2024-01-09"), (4, "a", None, False, "2024-01-09")],
        "id int, account_id string, consent_id string, is_transcript boolean, created_at timestamp")
    consents = frame(
        [("k1", "a", "v1", "2024-01-02"), ("k2", "a", "v2", "2024-01-04"), ("k3", "a", "v3", "2024-01-09")],
        "id string, account_id string, version string, accepted_at timestamp")
    missing = quality.transcripts_without_consent(docs, consents)
    assert rows(missing.select("id", "problem"), "id") == [(2, "missing"), (3, "unknown")]
    found = quality.consent_asof(docs, consents).select("id", "consent_in_force")
    assert rows(found, "id") == [(1, "k2"), (2, None), (3, "k3")]


def test_rules_from_json_or_array(frame):
    packs = frame([(1, '["x","y"]'), (2, "[]"), (3, "bad")], "id int, rules string")
    assert rows(policy.policy_rules(packs), "id", "rule_ix") == [(1, 0, "x"), (1, 1, "y")]
    arrays = packs.filter("id = 1").withColumn("rules", F.array(F.lit("z")))
    assert rows(policy.policy_rules(arrays)) == [(1, 0, "z")]


def test_text_pack_ids(frame):
    packs = frame([("x-1", None, "GB", True, "2024-01-01", None), ("y-2", None, "GB", True, "2024-01-01", "2024-02-01")],
                  PACKS.replace("id long", "id string", 1))
    graded = frame([(1, "a", "GB", "2024-01-10"), (2, "a", "GB", "2024-03-10"), (3, "a", "GB", "2024-03-11")],
                   "analysis int, account_id string, jurisdiction string, at timestamp")
    found = rows(policy.policy_snapshot(graded, packs, "at").select("analysis", "global_packs", "pack_set"), "analysis")
    assert [f[1] for f in found] == [2, 1, 1]
    assert found[0][2] != found[1][2] == found[2][2]


def test_tables_to_erase_from_are_stored_without_a_shuffle_of_their_own(spark, monkeypatch):
    from pactframe.plans import quality_queries as qq
    from pactframe.plans.registry import all_queries

    class Stored(Exception):
        pass

    def stop(root, tables, by=None, parts=None):
        raise Stored(by, parts, set(tables))

    monkeypatch.setattr(qq, "write_versioned", stop)
    with pytest.raises(Stored) as found:
        all_queries()["erase_in_files"](spark, "/root/testdata/sf0.001")
    assert found.value.args == (None, None, set(qq.COUNTED))


def test_lines_without_an_event_leave_the_audit_as_it_was(frame, spark, tmp_path):
    from pyspark.sql.types import StructType

    from pactframe.plans import quality_queries as qq
    from pactframe.sources.schemas import BASE_SCHEMAS
    from pactframe.sources.tables import Tables

    def save(name, given):
        columns = [F.col(f.name).cast(f.dataType) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(BASE_SCHEMAS[name]).fields]
        given.select(*columns).write.parquet(f"{tmp_path}/{name}.parquet")

    events = [(n, pick, n) for n, pick in zip([*range(-7, 60), 30, 31, None], ["view", "click", "error"] * 30)]
    save("events", frame(events, "event_id long, event_type string, user_id long"))
    save("lineitem", frame([(k, line, k + line, 7, 1.5) for k in [*range(-9, 200), 30] for line in range(-2, 6)] + [(None, 1, 1, 1, 1.0), (3, None, 1, 1, 1.0)],
                           "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"))
    t = Tables(spark, str(tmp_path))
    found = sorted(rows(qq.audit_rows(t)), key=repr)
    assert found == sorted(rows(t("dom_verification_audit")), key=repr)
    assert sum(r[1].startswith("p") for r in found if r[1]) > 30
    plan = qq.audit_rows(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("_words")


def test_pack_sets_match_plain_sets_and_members_are_not_shuffled(frame, monkeypatch):
    monkeypatch.setattr(policy, "BLOCK", 4)
    pick = random.Random(5)
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d} 00:00:00"
    packs = [(i, pick.choice([None, "a", "b"]), pick.choice(["GB", "ANY"]), i % 9 > 0, a := pick.randrange(90), pick.choice([None, a, a + pick.randrange(1, 90)])) for i in range(70)]
    analyses = [(pick.choice([None, "a", "b", "z"]), pick.choice(["GB", "US", "ANY"]), pick.randrange(200)) for _ in range(150)]
    expected = set()
    for account, where, at in analyses:
        for owner in {None, account}:
            for place in {where, "ANY"}:
                held = frozenset(i for i, o, w, active, start, end in packs if active and o == owner and w == place and start <= at and (end is None or at < end))
                expected |= {held} if held else set()
    packs = frame([(*p[:4], day(p[4]), None if p[5] is None else day(p[5])) for p in packs], PACKS.replace("timestamp", "string"))
    packs = packs.withColumns({c: F.col(c).cast("timestamp") for c in ("effective_from", "effective_to")})
    asked = frame([(a, w, day(n)) for a, w, n in analyses], "account_id string, jurisdiction string, at string").withColumn("at", F.col("at").cast("timestamp"))
    used = policy.used_pack_sets(asked, packs, "at")
    assert sorted(rows(used)) == sorted(rows(policy.analysis_pack_sets(asked, packs, "at").select("set_id").distinct()))
    found = policy.pack_sets(packs, used)
    sets = {}
    for r in found.collect():
        sets.setdefault(r.set_id, []).append(r.pack_id)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, expected)) and len(expected) > 30
    # what is listed goes to the result as it is
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    listed = [n for n, line in enumerate(plan) if "Generate explode" in line]
    joined = [n for n, line in enumerate(plan) if "Join " in line]
    assert listed[0] < joined[0]
