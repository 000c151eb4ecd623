"""Layouts, reversible escapes, loss spans, and the digests of the query."""

import hashlib
import json
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from pactframe.llm import chat_format as cf
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import FOLDER, rows_of

ODD = r"\### Assistant: </turn> ok"


def test_query(spark):
    want = defaultdict(list)
    for c, t, r, x in rows_of("conversations", "conv_id, turn, role, text"):
        want[c].append((t, r or "", x or ""))
    want[-7] = [(0, "user", ODD), (1, "assistant", ODD)]
    rows = QUERIES["op5_chat_format"](spark, FOLDER).collect()
    assert len(rows) == len(want)
    for r in rows:
        turns = sorted(want[r.conv_id])
        learned = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learned) and r.formatted_chars > 0
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


CONTROL = st.text(r"\#<>/turn: " + "\n", max_size=30)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), CONTROL, st.text(max_size=5)), st.one_of(CONTROL, st.text(max_size=20))), max_size=5))
def test_any_turns_can_be_read_back(turns):
    assert cf.read_back("".join(cf.segment(r, t)[0] for r, t in turns)) == turns
    for r, t in turns:
        piece, a, b = cf.segment(r, t)
        assert cf.unescape(piece[a:b]) == t


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"id": 1, "system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations",
     [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a"}, "prompt", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a"}, "completion", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": None, "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"question": "q", "answer": 42}, "question", [("user", "q"), ("assistant", "42")]),
    ({"data": {"dialog": [{"speaker": "bot", "utterance": "hi"}]}}, "nested", [("assistant", "hi")]),
    ({"turn": 3, "role": "user"}, "turn", [("user", "")]),
    ({"unknown": 1}, None, [(None, None)]),
    ({"messages": []}, None, [(None, None)]),
    ([1, 2], None, [(None, None)]),
]


def test_layouts(spark):
    rows = [(n, json.dumps(r), "own") for n, (r, _, _) in enumerate(RECORDS)] + [(90, None, "own"), (91, "not json", "own"), (92, "", "own")]
    out = cf.canonical_turns(spark.createDataFrame(rows, "key long, record string, position string"))
    assert out.columns == ["key", "layout", "position", "role", "text"]
    got = defaultdict(list)
    for r in out.orderBy("key", "position").collect():
        got[r.key].append((r.layout, r.role, r.text))
    for n, (_, layout, turns) in enumerate(RECORDS):
        assert got[n] == [(layout, *t) for t in turns], n
    assert all(got[n] == [(None, None, None)] for n in (90, 91, 92))


def test_every_layout_has_fingerprints_of_its_own():
    known = cf.fingerprints()
    assert {x.name for x in known.values()} == {x.name for x in cf.LAYOUTS}
    assert len(known) == sum(2 ** len(x.optional) for x in cf.LAYOUTS)


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame(rows, "conv long, turn long, role string, text string, segment string")


def test_whole_conversations(turns):
    rows = [(1, 1, "assistant", ODD, "x"), (1, 0, "user", "é", "x"), (1, 2, "assistant", "", "x"), (2, 0, "system", None, "x"), (None, 0, None, "t", "x")]
    made = cf.format_turns(turns(rows))
    assert made.columns == ["conv", "turn", "role", "text", "segment", "loss_start", "loss_end"]
    whole = {r.conv: r for r in cf.conversations(made, "conv", ("turn",)).collect()}
    assert cf.read_back(whole[1].formatted) == [("user", "é"), ("assistant", ODD), ("assistant", "")]
    assert "".join(cf.unescape(whole[1].formatted[s.start : s.end]) for s in whole[1].loss_spans) == ODD
    assert not whole[2].loss_spans and cf.read_back(whole[None].formatted) == [("", "t")]
    digests = {r.conv: r for r in cf.digests(made, "conv", ("turn", "segment")).collect()}
    assert digests[1].formatted_chars == len(whole[1].formatted) and digests[None].n_turns == 1


def test_long_conversation_repeats_and_empty_table(turns):
    rows = [(1, n, "assistant", f"t{n}", "") for n in range(5000)] + [(2, 0, "user", "same", "")] * 2 + [(3, None, "user", "x" * 1_000_000, "")]
    got = {r.conv: r for r in cf.digests(cf.format_turns(turns(rows)), "conv", ("turn", "segment")).collect()}
    assert got[1].n_turns == 5000 and got[2].n_turns == 2 and got[3].formatted_chars > 1_000_000
    assert cf.digests(cf.format_turns(turns([])), "conv", ("turn",)).count() == 0


def test_odd_turns_and_deep_nesting_are_unknown(spark):
    good = {"role": "user", "content": "hi"}
    rows = [json.dumps({"messages": [good, odd]}) for odd in (None, "text", 3, [good])]
    rows += ["[" * 100_000 + "]" * 100_000, '{"messages":' * 50_000 + "1" + "}" * 50_000, json.dumps({"messages": [good]})]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, record string")
    got = {r.id: (r.layout, r.role, r.text) for r in cf.canonical_turns(df).collect()}
    assert got == {**{n: (None, None, None) for n in range(len(rows) - 1)}, len(rows) - 1: ("messages", "user", "hi")}
