import datetime as dt

import pytest
from pyspark.sql import functions as F

from pactframe.operators import accounts, replies
from tests.conftest import rows

INVITATIONS = "token string, account_id string, role string, email string, expires_at timestamp, accepted_at timestamp"
ATTEMPTS = "id long, user_id string, email string, token string, ts timestamp"


def test_invitations(frame):
    offers = frame(
        [("t1", "a", "admin", "Ann@x.org", "2024-02-01", None), ("t2", "a", "member", "b@x.org", "2024-01-05", None),
         ("t3", "a", "viewer", "c@x.org", "2024-02-01", "2024-01-01"), ("t4", "b", "member", "d@x.org", "2024-02-01", None)], INVITATIONS)
    tried = frame(
        [(1, None, "ann@x.org", "t1", "2024-01-01"), (2, "u2", "bob@x.org", "t1", "2024-01-02"), (3, "u3", "ANN@x.org", "t1", "2024-01-03"),
         (4, "u4", "ann@x.org", "t1", "2024-01-04"), (5, "u5", "b@x.org", "t2", "2024-01-05"), (6, "u6", "c@x.org", "t3", "2024-01-05"),
         (7, "u7", "x", "zzz", "2024-01-05"), (8, "u8", "d@x.org", "t4", "2024-01-05"), (9, "u9", "z@x.org", "t1", "2024-01-06")], ATTEMPTS)
    outcomes = accounts.invitation_outcomes(tried, offers)
    lost = "invitation not found or expired"
    assert rows(outcomes.select("id", "outcome"), "id") == [
        (1, "not signed in"), (2, "this invitation was sent to Ann@x.org"), (3, "accepted"), (4, lost), (5, lost), (6, lost),
        (7, lost), (8, "accepted"), (9, lost)]
    members = frame([("u3", "a", "viewer"), ("u1", "a", "owner")], "user_id string, account_id string, role string")
    assert rows(accounts.upsert_members(members, outcomes), "user_id") == [("u1", "a", "owner"), ("u3", "a", "admin"), ("u8", "b", "member")]


def test_signups(frame):
    data = frame(
        [(1, " ", "B", "bad", "", "x", False), (2, "A", "B", "bad address", "C", "growth", False), (3, "A", "B", "a@b.co", "C", None, False),
         (4, "A", "B", " a@b.co ", "C", "enterprise", True), (5, "A", "B", "a@b", "C", "sandbox", True), (6, "A", None, "a@b.co", "C", "growth", True)],
        "id int, first_name string, last_name string, email string, company string, plan string, terms boolean")
    reasons = [r.reject_reason and r.reject_reason[:16] for r in accounts.signup_checks(data).orderBy("id").collect()]
    assert reasons == ["Please complete ", "Please enter a v", "Please accept th", None, "Please enter a v", "Please complete "]
    routed = rows(accounts.signup_routing(data).select("effective_plan", "route", "asks_vat"), "id")
    assert routed == [("growth", "payment", True)] * 3 + [("enterprise", "sales", True), ("sandbox", "workspace", False), ("growth", "payment", True)]


def test_provisioning(frame):
    users = frame(
        [("1", "ann@acme-corp.co.uk", '{"full_name":null,"name":"Ann"}'), ("2", "bob", "{}"), ("3", "c@x.org", '{"company":"Acme"}')],
        "id string, email string, meta string")
    made, spaces, members = accounts.provision_accounts(users, frame([("3",)], "id string"))
    assert rows(made, "id") == [("1", "ann@acme-corp.co.uk", "Ann"), ("2", "bob", "bob")]
    assert sorted(r.name for r in spaces.collect()) == ["", "Acme", "Acme-Corp"]
    again = accounts.provision_accounts(users, frame([], "id string"))[2]
    assert rows(members, "user_id") == rows(again, "user_id")


def test_terms(frame):
    profiles = frame([("u", "2024-01-01", "old"), ("v", None, None)], "id string, terms_accepted_at timestamp, terms_version string")
    given = frame([("v", "2024-02-01", "a"), ("v", "2024-03-01", "b")], "user_id string, accepted_at timestamp, version string")
    assert rows(accounts.terms_acceptance(profiles, given), "id") == [("u", dt.datetime(2024, 1, 1), "old"), ("v", dt.datetime(2024, 3, 1), "b")]


@pytest.mark.parametrize(
    "text, json",
    [
        ('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('```JSON {"a":1}```', '{"a":1}'), ('\n\t ```\n{"a":1}``` ', '{"a":1}'),
        ('Here you go: {"a":{"b":2}} as asked', '{"a":{"b":2}}'), ("[1,2]", "[1,2]"), ("7", "7"), ("no braces", None),
        ('{"a":1} {"b":2}', None), ('{"a":1},{"b":2}', None), ('{"a":1}] [{"b":2}', None), ('} "x" {', None), ("", None), (None, None),
        ("{'a':1}", None), ('{"a":1', None), ('{"a":"}{"}', '{"a":"}{"}'),
    ],
)
def test_json_from_replies(frame, text, json):
    got = replies.extract_json(frame([(1, text)], "id int, text string")).select(F.to_json("parsed"), "quarantine").first()
    assert got[0] == json
    assert (got[1] is None) == (json is not None)


def test_reply_text_and_results(frame, spark):
    kind = "array<struct<type:string,text:string>>"
    data = spark.createDataFrame(
        [(1, [("text", "a"), ("tool", "x"), ("text", None), ("text", "b")]), (2, []), (3, None)], f"id int, content {kind}")
    assert [r.text for r in replies.reply_text(data).orderBy("id").collect()] == ["a\n\nb", "", ""]
    found = replies.reply_results(frame([(1, "analysis", '{"a":1}'), (2, "reanalysis", "oops"), (3, "question", 'say "hi"')], "id int, kind string, text string"))
    assert rows(found.select(F.to_json("result"), "failed"), "id") == [('{"a":1}', False), (None, True), ('{"text":"say \\"hi\\""}', False)]


def test_points_from_analysis(frame):
    good = ('{"extractions":[{"field":"f","value":"v","confidence":80}],"risks":[{"field":"r","confidence":101},{"value":"no field"},{"field":"h","confidence":"high"},{"field":"n"}],'
            '"clauses":[{"field":"c","value":"x","confidence":0,"reasoning":"why","source":"p1"}]}')
    data = frame([(1, good), (2, '{"clauses":"none"}'), (3, "not json"), (4, None)], "id int, analysis string")
    expected = [(1, "clause", "c", "x", 0, "why", "p1"), (1, "extraction", "f", "v", 80, None, None)]
    def valid(df):
        return rows(replies.analysis_to_data_points(df).filter("quarantine is null").drop("quarantine"), "id", "kind")

    assert valid(data) == expected
    bad = replies.analysis_to_data_points(data).filter("quarantine is not null").select("field", "quarantine", "confidence")
    assert sorted(rows(bad), key=str) == [("h", "confidence", None), ("n", "confidence", None), ("r", "confidence", None), (None, "no field", None)]
    variants = data.withColumn("analysis", F.try_parse_json("analysis"))
    assert valid(variants) == expected
    assert replies.analysis_to_data_points(variants).filter("quarantine is not null").count() == 4
