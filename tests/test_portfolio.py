import datetime as dt
import itertools
import random

from pactframe.operators import portfolio
from tests.conftest import rows

CONTRACTS = "id string, supplier string, end_date date, notice_period_days int, auto_renew boolean, annual_value int, users_count int"


def test_runway(frame):
    data = frame(
        [("n", "s", "2000-12-31", None, True, 1, 0), ("edge", "s", "2000-07-30", 30, True, 2, 0), ("late", "s", "2000-07-29", 30, False, 3, 0),
         ("long", "s", "2001-01-01", 900, False, 4, 0), ("open", "s", None, 30, False, 5, 0)], CONTRACTS)
    found = {r.id: (r.deadline, r.missed) for r in portfolio.renewal_runway(data, "2000-06-30").collect()}
    assert found["n"] == (dt.date(2000, 10, 2), False)
    assert found["edge"] == (dt.date(2000, 6, 30), False)
    assert found["late"] == (dt.date(2000, 6, 29), True)
    assert found["long"][1] is True and found["open"] == (None, None)


def test_supplier_keys(frame):
    names = frame([("Acme Ltd",), ("ACME, Inc.",), ("The Acme",), ("Acme Ltd",), ("Apex GmbH",)], "supplier string")
    found = rows(portfolio.supplier_merge(names), "supplier_key")
    assert found == [("acme", "ACME, Inc.", 3, 4), ("apex", "Apex GmbH", 1, 1)]


def edits(a, b):
    """Edit distance, the textbook way."""
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
    return line[-1]


def test_near_misses_match_every_pair(frame):
    pick = random.Random(11)
    names = {"acme"} | {"acme" + "".join(pick.choice("abc") for _ in range(pick.randrange(7))) for _ in range(80)}
    names |= {"ac", "a", "acmx", "north works", "north work", "north wrk", "south works", "kone", "cone"}
    expected = {}
    for a, b in itertools.permutations(names, 2):
        if edits(a, b) <= 2:
            low, high = expected.get(a, (None, None))
            if b < a:
                low = b if low is None else min(low, b)
            else:
                high = b if high is None else max(high, b)
            expected[a] = (low, high)
    found = portfolio.supplier_near_misses(frame([(n,) for n in names], "supplier string"))
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == expected


def test_clauses(frame):
    points = frame([("c1", "clause", "x"), ("c1", "clause", "x"), ("c2", "clause", "y"), ("c3", "risk", "x"), ("c4", "clause", "other")],
                   "contract_id string, kind string, field string")
    contracts = frame([("c1",), ("c2",), ("c3",), ("c4",), ("c5",)], "id string")
    assert rows(portfolio.clause_matrix(contracts, points, ["x", "y"]), "contract_id") == [
        ("c1", 1, 0, 0), ("c2", 0, 1, 0), ("c3", 0, 0, 0), ("c4", 0, 0, 1), ("c5", 0, 0, 0)]
    assert rows(portfolio.clause_gaps(contracts, points, ["x", "y"]), "axis", "name") == [
        ("clause", "x", 4), ("clause", "y", 4), ("contract", "c1", 1), ("contract", "c2", 1), ("contract", "c3", 2), ("contract", "c4", 2), ("contract", "c5", 2)]


def test_commitments(frame):
    turns = frame(
        [(1, 0, "c1", "Hello. We will deliver monthly reports by Friday! I shall call."), (2, 0, "c2", "We agree to pay. Nothing else")],
        "conv_id int, turn int, contract_id string, text string")
    texts = frame([("c1", "Reports are monthly; delivery"), ("c1", "Friday deadline")], "contract_id string, text string")
    found = portfolio.verbal_commitments(turns, texts).select("contract_id", "sentence", "found")
    assert rows(found, "contract_id", "sentence") == [("c1", "I shall call", 0), ("c2", "We agree to pay", 0)]


def test_ocr_and_licences(frame):
    docs = frame([(1, "x" * 99, 2), (2, "x" * 100, 2), (3, None, None)], "id int, extracted_text string, page_count int")
    assert [r.needs_ocr for r in portfolio.needs_ocr(docs).orderBy("id").collect()] == [True, False, True]
    contracts = frame([("c1", "s", None, None, None, 0, 2), ("c2", "s", None, None, None, 0, 5)], CONTRACTS)
    users = frame([("c1", "2000-06-29"), ("c1", None), ("c1", "2000-01-01")], "contract_id string, last_active date")
    found = rows(portfolio.licence_usage(users, contracts, "2000-06-30").select("contract_id", "listed", "idle", "over_licence"), "contract_id")
    assert found == [("c1", 3, 2, 1), ("c2", 0, 0, -5)]


def plain_classes(names):
    near = {a: [b for b in names if b != a and naive_distance(a, b) <= 2] for a in names}
    out = {}
    for a in names:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if near[a]:
            out[a] = (min(seen), len(near[a]))
    return out


def naive_distance(a, b):
    if abs(len(a) - len(b)) > 2:
        return 3
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_miss_classes_match_every_pair(frame):
    pick = random.Random(4)
    names = {"".join(pick.choices("abcé", k=pick.randrange(1, 9))) for _ in range(300)} | {f"number {n}" for n in range(80)} | {"a", "ab", "zzzzzzzzzz"}
    found = {r.supplier_key: (r["class"], r.links) for r in portfolio.near_miss_classes(frame([(n,) for n in names], "supplier string")).collect()}
    assert found == plain_classes(names)


def test_near_misses_of_long_names(frame):
    long = "".join(random.Random(1).choices("abcdefgh", k=1000))
    names = [long, long[:500] + "x" + long[500:], long[:10] + long[11:600] + long[601:], long[:-1] + "zz", "y" * 1000, "y" * 1003]
    found = {r.supplier_key: r.links for r in portfolio.near_miss_classes(frame([(n,) for n in names], "supplier string")).collect()}
    assert found == {n: sum(naive_distance(n, m) <= 2 for m in names if m != n) for n in names[:4]}


def test_no_names_no_classes(frame):
    assert portfolio.near_miss_classes(frame([(None,), ("Ltd",), ("alone",)], "supplier string")).collect() == []
