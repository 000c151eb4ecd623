"""Sets of numbers as bits, and filters of keys by their hash."""

import random

from pyspark.sql import functions as F

from pactframe.functions.bits import bit_rows, holds, key_bits, may_match

PICK = random.Random(8)
NUMBERS = sorted({0, 7, 8, 62, 63, 64, 32_767, 32_768, (5 << 40) + 3, *range(1_000, 1_064), *(PICK.randrange(200_000) for _ in range(3_000))})


def test_bits_hold_just_their_numbers(frame):
    bits = bit_rows(frame([(n,) for n in NUMBERS * 2], "n long"), "n")
    asked = sorted({m for n in NUMBERS for m in (n - 1, n, n + 1, n + 64) if m >= 0} | {6 << 40})
    rows = frame([(m,) for m in asked], "m long").withColumn("_run", F.shiftright("m", 15))
    found = rows.join(bits, "_run", "left").where(holds("_words", "m")).collect()
    assert sorted(r.m for r in found) == NUMBERS
    assert all(len(r._words) == 512 for r in bits.collect())


def test_kinds_have_bits_of_their_own(frame):
    bits = bit_rows(frame([("a", 3), ("b", 5), ("a", 40_000)], "kind string, n long"), "n", "kind")
    assert sorted((r.kind, r._run) for r in bits.collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_a_filter_loses_no_key_and_most_others(frame):
    keys = frame([(f"k{n}", n % 7) for n in range(500)], "k string, n long")
    rows = frame([(f"k{n}", n % 7) for n in range(4_000)] + [(None, 1), ("k3", None), ("k3", 3)], "key string, part long")
    bits, mask = key_bits(keys, 500)
    passed = may_match(rows, [F.col("key"), F.col("part")], bits, mask)
    assert passed.columns == ["key", "part"]
    held = [tuple(r) for r in passed.collect()]
    assert {(f"k{n}", n % 7) for n in range(500)} <= set(held) and held.count(("k3", 3)) == 2
    assert len(held) < 500 + 3_500 // 8
    plan = passed._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "Exchange" not in plan
