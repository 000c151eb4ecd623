"""Repairs against a search through all edits, and the query against plain code."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import Row

from pactframe.llm import turn_repair as tr
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import FOLDER, rows_of

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 0:
            out.append((conv, None))
            continue
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        out += [(conv, (turn, role, text))] * (2 if lot == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, bad):
    """(cost, audit, roles and texts) of the least edits, by trying all of them from every place and state."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {"u": "user", "a": "assistant"}

    @functools.cache
    def least(i, q, more):
        found = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        if more:
            for c in "ua":
                if c in after[q]:
                    cost, audit, kept = least(i, after[q][c], more - 1)
                    found.append((cost + 5, "I" + audit, ((name[c], ""), *kept)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, kept = least(i + 1, q, 4)
            found.append((cost + 2, "D" + audit, kept))
            if bad[i] not in ("blank", "duplicate"):
                extra = 5 if bad[i] else 0
                if role[:1] in after[q]:
                    cost, audit, kept = least(i + 1, after[q][role[:1]], 4)
                    found.append((cost + extra, "K" + audit, ((role, text), *kept)))
                for c in "ua":
                    if c in after[q]:
                        cost, audit, kept = least(i + 1, after[q][c], 4)
                        found.append((cost + 1 + extra, "R" + audit, ((name[c], text), *kept)))
        return min(found, default=(10**9, "", ()))

    return least(0, 0, 4)


def expected(rows):
    groups = {}
    for conv, row in plain_damage(rows):
        groups.setdefault(conv, [])
        if row:
            groups[conv].append(row)
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        bad = faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, kept = plain_repair(tuple(turns), tuple(bad))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(bad.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def query_on(spark, tmp_path, rows, extra=False):
    kind = "conv_id long, turn long, role string, text string" + (", seen string, audit string" if extra else "")
    spark.createDataFrame([(*r, "own", "own") if extra else r for r in rows], kind).write.parquet(str(tmp_path / "conversations.parquet"))
    return QUERIES["op13_turn_repair"](spark, str(tmp_path))


def test_query_equals_plain_code(spark):
    rows = rows_of("conversations", "conv_id, turn, role, text")
    df = QUERIES["op13_turn_repair"](spark, FOLDER)
    assert df.columns[:1] == ["conv_id"] and got(df) == expected(rows)
    assert df.count() == len({r[0] for r in rows})


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Fine.", "Cut off", "", " \t", None, "Why?", "é漢!", "Fine."]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(1, 14))]
    rows += [(7, 1, "user", "same row."), (7, 1, "user", "same row."), (500, None, "system", "only a null turn."), (501, 3, "user", "x" * 2_000_000)]
    assert got(query_on(spark, tmp_path, rows, extra=True)) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert query_on(spark, tmp_path, []).collect() == []


def test_blocks_decide_as_one_integer_would(monkeypatch):
    rng = random.Random(9)
    for _ in range(300):
        turns = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["ok.", "cut", ""])) for i in range(rng.randrange(1, 30))]
        bad = ["blank" if not t else rng.choice(["", "duplicate", "truncated"]) for _, _, t in turns]
        want = plain_repair(tuple(turns), tuple(bad))
        for block in (1, 2, 5, 128):
            monkeypatch.setattr(tr, "BLOCK", block)
            monkeypatch.setattr(tr, "WIDTH", tr.BITS * (3 * block + 2))
            paths = tr.Paths()
            for (_, role, _), b in zip(turns, bad):
                paths.read(role[:1], b in ("blank", "duplicate"), b == "truncated")
            assert paths.best() == want[:2]


def test_repaired_turns_are_rows(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Again."), (2, 1, "assistant", "No."), (3, 5, "user", "")]
    planned, turns = tr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: r["audit"] for r in planned.collect()} == {1: "KR", 2: "D", 3: "D"}
    assert sorted(turns.collect()) == [Row(conv_id=1, position=0, role="user", text="Hi.", edit="K"),
                                       Row(conv_id=1, position=1, role="assistant", text="Again.", edit="R")]


@pytest.mark.parametrize("size", [20_000])
def test_long_conversation(spark, size):
    roles = ["user", "assistant", "assistant", "tool"]
    df = spark.range(size).selectExpr("cast(id % 2 as long) * 0 as conv_id", "id as turn", "element_at(array('user','assistant','assistant','tool'), cast(id % 4 as int) + 1) as role",
                                      "case when id % 7 = 0 then '' else concat('turn ', id % 5000, '.') end as text")
    planned, turns = tr.repair(df)
    seen, states = set(), tr.Paths()
    for i in range(size):
        role, text = roles[i % 4], "" if i % 7 == 0 else f"turn {i % 5000}."
        states.read(role[:1], not text or (role, text) in seen, False)
        seen.add((role, text))
    cost, audit = states.best()
    row = planned.first()
    assert (row["cost"], row["audit"]) == (cost, audit) and len(audit.replace("I", "")) == size
    assert turns.count() == len(audit) - audit.count("D")
