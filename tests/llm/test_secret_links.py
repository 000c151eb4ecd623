"""Secret spans against plain patterns; weak parts with and without a partner."""

import hashlib
import re

import pytest

from pactframe.llm import secret_links as sl
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import EDGES, FOLDER

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
KEY = "AKIA" + "ABCD1234EFGH5678"
RANDOM = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def plain_base(text):
    text = text or ""
    found = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), 2) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted((a, k, b) for a, b, k in found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


CASES = EDGES + [
    (10, "é token = abcdef0123 and TOKEN:x password='short' apikey=\"abc.def-ghi\""),
    (11, f"x{KEY}{KEY} and AKIA123 AKIAAKIA{'A' * 12}"),
    (12, "deadbeef" * 3 + " " + "a" * 23 + " " + "0" * 24),
    (13, "token=token:abcdefgh secret==abcdef"),
    (14, " ".join(f"token={n:06d}x" for n in range(500))),
    (15, "paſſword: notascii Key=abcdefg api_Key=abcdefg"),
]


def test_query(spark, documents):
    rows = QUERIES["op7_secret_scan"](spark, FOLDER).collect()
    assert len(rows) == len(documents)
    for r in rows:
        base = plain_base(documents[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, _, _ in base) for k in ("assign", "access", "hex"))


def test_base_spans_of_odd_texts(docs):
    out = sl.scan(docs(CASES, "secrets"))
    assert out.columns == ["doc_id", "text", "secrets"]
    rows = out.collect()
    assert len(rows) == len(CASES)
    for r in rows:
        got = [tuple(s) for s in r.secrets if s.kind in ("assign", "access", "hex")]
        assert got == plain_base(r.text), r.doc_id


@pytest.mark.parametrize("text, kinds", [
    (f"user: deploy pwd={'x' * 8}", {"id", "short"}),
    (f"pwd={'x' * 8} alone", set()),
    ("user: deploy alone", set()),
    ("https://db.example.com/x alone", set()),
    (f"{KEY} then {RANDOM}", {"access", "random"}),
    (RANDOM, set()),
    (f"https://api.example.com/v1 auth: {'k' * 9}", {"endpoint", "short"}),
    (f"user: deploy {'word ' * 60} pwd={'x' * 8}", set()),
    ("host=db1.internal login=root", set()),
    (f"host=db1.internal token={'q' * 9}", {"host", "assign"}),
])
def test_weak_parts_need_a_partner(docs, text, kinds):
    (row,) = sl.scan(docs([(1, text)])).collect()
    assert {s.kind for s in row.secrets} == kinds


def test_scope_is_measured_between_the_spans(docs):
    for gap, found in ((sl.SCOPE, True), (sl.SCOPE + 1, False)):
        text = "." * 1000 + "login=root" + " " * gap + "pwd=xxxxxxxx"
        (row,) = sl.scan(docs([(1, text)])).collect()
        assert bool(row.secrets) == found, gap


def test_many_parts_in_one_text_and_many_copies(docs):
    text = " ".join(f"login=user{n} pwd=pass{n:04d}" for n in range(2000))
    rows = sl.scan(docs([(n, text) for n in range(30)])).collect()
    assert all(len(r.secrets) == 4000 for r in rows)


def test_redaction(docs):
    rows = sl.redact(docs([(1, f"é a token = abcdef0123 b {KEY}."), (2, None), (3, "nothing"), (4, "secret=" + "ab12" * 8)], "secrets"))
    assert rows.columns == ["doc_id", "text", "secrets"] and {r.secrets for r in rows.collect()} == {"own"}
    assert {r.doc_id: r.text for r in rows.collect()} == {1: "é a [SECRET] b [SECRET].", 2: None, 3: "nothing", 4: "[SECRET]"}


def test_empty_table(docs):
    assert sl.scan(docs([])).count() == 0 and sl.redact(docs([])).count() == 0


def test_no_python_in_the_plan(spark):
    from tests.test_plans import plan_of

    assert not re.search("Python|Arrow|Pandas", plan_of(QUERIES["op7_secret_scan"](spark, FOLDER)))


@pytest.mark.parametrize("size", [32, 88, 89, 500])
def test_unnamed_secrets_of_any_length(spark, size):
    value = ("aB3" * size)[:size]
    rows = spark.createDataFrame([(1, f"user_name: mallory and {value} here")], "doc_id long, text string")
    spans = sl.scan(rows).first()["secrets"]
    assert [(s["start"], s["end"]) for s in spans if s["kind"] == "random"] == [(23, 23 + size)]
