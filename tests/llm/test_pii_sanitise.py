"""Base spans against plain patterns; terms that give an entity away."""

import hashlib
import re

from hypothesis import given, settings, strategies as st

import pytest

from pactframe.llm import pii_sanitise as ps
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import EDGES, FOLDER

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
        "card": 14 <= len(digits) <= 19 and luhn(digits),
        "phone": 10 <= len(digits) <= 15,
    }[kind]


def plain_base(text):
    order = list(PLAIN)
    found = [(m.start(), order.index(k), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if passes(k, m.group())]
    return [(order[k], a, b) for a, k, b in sorted(found)]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text("ab1.@-+_%é \n", max_size=40), st.text("0123456789.- +()", max_size=50), st.text(max_size=30)))
def test_base_spans_equal_the_plain_patterns(text):
    assert [(ps.KINDS[k], a, b) for a, k, b in ps.base_spans(text)] == plain_base(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 50_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 200_000):
        ps.base_spans(text)


def test_query(spark, documents):
    rows = QUERIES["op3_personal_data"](spark, FOLDER).collect()
    assert len(rows) == len(documents)
    for r in rows:
        base = plain_base(documents[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in PLAIN)
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def corpus():
    """One person whose rare nickname stands near the address in five documents, among ordinary ones."""
    rows = [(n, f"text number {n} about the weather in town {'abcdefgh'[n % 8]} and nothing else of note") for n in range(200)]
    rows += [(500 + n, f"Today the weather in town was fine, wrote Zorblax from lake {'abcde'[n] * 3} "
              f"to zb@mail.example.com about case {n}. Zorblax signs.") for n in range(5)]
    rows += [(600, "Zorblax alone, without any address")]
    return rows


def test_terms_that_reveal_an_entity(docs):
    rows = {r.doc_id: r for r in ps.scan(docs(corpus(), "spans")).collect()}
    assert len(rows) == 206
    text = rows[500].text
    terms = [text[s.start : s.end] for s in rows[500].spans if s.kind == "term"]
    assert terms.count("Zorblax") == 2 and "weather" not in terms and "town" not in terms
    assert not rows[600].spans and not rows[3].spans
    assert [s.kind for s in rows[500].spans] == [s.kind for s in sorted(rows[500].spans, key=lambda s: s.start)]


def test_copies_are_no_evidence(docs):
    rows = [(n, f"text number {n} about the weather in the old town tonight") for n in range(100)]
    rows += [(n, "Zorblax lives by the lake, zb@mail.example.com he says") for n in range(200, 260)]
    assert all(s.kind == "email" for r in ps.scan(docs(rows)).collect() for s in r.spans)


def test_sanitised_text(docs):
    rows = {r.doc_id: r.text for r in ps.sanitise(docs([*corpus(), (700, None), (701, "call +1 (555) 010-9999 or 10.0.0.1 é")], "note")).collect()}
    assert "zb@" not in rows[500] and "[EMAIL]" in rows[500] and "Zorblax" not in rows[500]
    assert rows[600].startswith("Zorblax") and rows[700] is None
    assert rows[701] == "call [PHONE] or [IP] é"
    assert ps.replacement("term", "Anna", 0.85) == "[NAME]" and ps.replacement("term", "lake", 0.85) == "[TERM]"


def test_edges_and_empty_table(docs):
    out = ps.scan(docs(EDGES, "spans"))
    assert out.columns == ["doc_id", "text", "spans"]
    rows = out.collect()
    assert len(rows) == len(EDGES) and all([(s.kind, s.start, s.end) for s in r.spans] == plain_base(r.text) for r in rows)
    assert ps.scan(docs([])).count() == 0 and ps.sanitise(docs([])).count() == 0


def test_terms_far_from_the_entity_count(docs):
    """The nickname stands a thousand words away from the address."""
    far = "the weather in town was fine " * 200
    rows = corpus()[:200] + [(500 + n, f"Zorblax wrote {far} case {'abcde'[n] * 3} zb@mail.example.com") for n in range(5)]
    found = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in ps.scan(docs(rows)).collect()}
    assert all(("term", "Zorblax") in found[500 + n] for n in range(5))
    assert not any(w in ("weather", "town") for spans in found.values() for _, w in spans)


def test_terms_are_found_in_documents_without_the_entity(docs):
    rows = {r.doc_id: r for r in ps.scan(docs(corpus()), everywhere=True).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[600].spans] == [("term", 0, 7)] and not rows[3].spans
    clean = {r.doc_id: r.text for r in ps.sanitise(docs(corpus()), everywhere=True).collect()}
    assert all("Zorblax" not in t for t in clean.values()) and len(clean) == len(corpus())


@pytest.mark.parametrize("everywhere", [False, True])
def test_joined_terms_give_what_held_ones_give(spark, docs, monkeypatch, everywhere):
    monkeypatch.setattr(ps, "PACKED", 50)
    rows = docs([*corpus(), *EDGES])
    got = [sorted(map(repr, ps.scan(rows, everywhere=everywhere, held=held).collect())) for held in (ps.HELD, 0)]
    assert got[0] == got[1] and any("kind='term'" in r for r in got[0])


def test_own_columns_with_odd_names_stay(spark):
    df = spark.createDataFrame([(1, "x@y.org", "a", "b", "c")], "doc_id long, text string, __hit string, __row string, row string")
    found = ps.scan(df)
    assert found.columns == [*df.columns, "spans"] and tuple(found.first())[:5] == (1, "x@y.org", "a", "b", "c")
