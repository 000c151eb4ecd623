"""Ranked search against plain scores of every document, and against SQL."""

import math
import random
import re

import duckdb
import pytest

from pactframe.llm import bag_search as bs
from pactframe.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import EDGES, FOLDER

TERM = re.compile(bs.PATTERN)


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items):
    bags = [(d, words(t)) for d, t in docs]
    N, L = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    df = {t: sum(t in set(w) for _, w in bags) for t in set().union(*wanted.values())} if wanted else {}
    out = []
    for i, terms in wanted.items():
        scores = []
        for d, w in bags:
            if w:
                m = 100 - 50 + 50 * len(w) * N // L
                s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in terms)
                if s > 0:
                    scores.append((-s, d is None, d or 0, d))
        out += [(i, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:50])]
    return sorted(out, key=repr)


def got(spark, docs, items, text="text"):
    d = spark.createDataFrame([(*r, "own", 1) for r in docs], "doc_id long, text string, hash string, m long")
    i = spark.createDataFrame([(*r, "own") for r in items], "item_id long, text string, rank string")
    df = bs.search(d, i)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES["op12_ranked_search"](spark, FOLDER)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(ORACLES["op12_ranked_search"]).fetchall())
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_odd_rows_ties_and_copies(spark):
    rng = random.Random(2)
    vocabulary = ["the", "The", "é", "漢字", "a1", "x_y", "contract", "party", "İ", "ÀB", "z"]
    docs = [(n, rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=rng.randrange(0, 9)))) for n in range(300)]
    docs += [(1000 + n, "the contract of a party") for n in range(400)] + EDGES + [(7, "contract"), (7, "contract"), (None, "party contract")]
    rng.shuffle(docs)
    items = [(1, "The contract"), (2, None), (3, ""), (4, "party party É é"), (4, "a1-z"), (5, "nowhere"), (None, "lorem ipsum"), (6, "x y İ à")]
    assert got(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("chars, cells", [(5, 1 << 20), (10**6, 1), (10**6, 64)])
def test_blocks_of_items_and_rows(spark, monkeypatch, chars, cells):
    monkeypatch.setattr(bs, "CELLS", cells)
    blocks = bs.item_blocks
    monkeypatch.setattr(bs, "item_blocks", lambda items: blocks(items, chars))
    docs = [(n, " ".join(["a"] * (n % 7) + ["b"] * (n % 3) + ["c"])) for n in range(130)]
    items = [(1, "a b"), (2, "b c"), (3, "c"), (4, "a a a")]
    assert got(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "- -")], [(1, "a")])])
def test_nothing_to_find(spark, docs, items):
    assert got(spark, docs, items) == []


def test_large_weights_add_up_in_integers(spark, monkeypatch):
    docs = [(n, "a b " * (n % 5) + "c") for n in range(40)]
    want = got(spark, docs, [(1, "a b c")])
    real = bs.weights
    monkeypatch.setattr(bs, "weights", lambda df, n: real(df, n) + (1 << 40))
    large = got(spark, docs, [(1, "a b c")])
    assert len(large) == len(want) and large != want
