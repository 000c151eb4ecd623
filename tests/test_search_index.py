"""The stored index: changes against rebuilds, what a change writes, and BM25 against plain scores."""

import math
import random
import re
from pathlib import Path

import pytest

from pactframe.functions.text import normal_term
from pactframe.operators import search, search_index as si

DDL = "id long, name string, extracted_text string"
WORDS = ["alpha", "beta", "gamma", "delta", "common", "rare", "terms", "payment", "zeta", "yield"]


def made(n, seed=1):
    rng = random.Random(seed)
    return {i: (rng.choice([None, "", "alpha note", "Payment"]), rng.choice([None, " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))])) for i in range(n)}


def table(frame, docs):
    return frame([(i, *v) for i, v in docs.items()], DDL)


def contents(spark, path):
    live = si.live_postings(spark, path)
    return (sorted((r.doc_id, r.field, r.term, r.tf, tuple(r.positions), r.length) for r in live.collect()),
            sorted(map(tuple, si.term_counts(spark, path).collect()), key=repr),
            sorted((r.doc_id, r.content, r.length, tuple(sorted(r.terms))) for r in si.live_docs(spark, path).collect()))


def rebuilt(frame, spark, docs, path):
    si.build(table(frame, docs), str(path))
    return contents(spark, str(path))


def files(path, kind):
    return {p for p in Path(path, kind).rglob("*.parquet")}


def test_changes_equal_a_rebuild(frame, spark, tmp_path):
    path, docs = str(tmp_path / "i"), made(150)
    si.build(table(frame, docs), path)
    assert contents(spark, path) == rebuilt(frame, spark, docs, tmp_path / "r0")
    rng = random.Random(5)
    for step in range(3):
        for i in rng.sample(sorted(docs), 6):
            if rng.random() < 0.5:
                del docs[i]
            else:
                docs[i] = (docs[i][0], f"changed {step} alpha rare")
        docs[1000 + step] = ("new", "common words")
        si.refresh(table(frame, docs), path)
        assert contents(spark, path) == rebuilt(frame, spark, docs, tmp_path / f"r{step + 1}")
        if step == 1:
            si.compact(spark, path, [0, 1, 2, 3])
            assert contents(spark, path) == rebuilt(frame, spark, docs, tmp_path / "part")
    si.compact(spark, path)
    state = si.state_of(spark, path)
    assert state["dead"] == [] and all(len(ss) == 1 for ss in state["parts"].values())
    assert contents(spark, path) == rebuilt(frame, spark, docs, tmp_path / "all")


def test_a_change_writes_its_documents_only(frame, spark, tmp_path):
    path, docs = str(tmp_path / "i"), made(200)
    si.build(table(frame, docs), path)
    before = files(path, "postings")
    docs[7], docs[8] = ("x", "one two three"), (None, "four")
    del docs[9]
    state = si.refresh(table(frame, docs), path)
    assert before <= files(path, "postings")
    new = spark.read.parquet(f"{path}/postings/segment={state['segment']}")
    assert {r.doc_id for r in new.select("doc_id").distinct().collect()} == {7, 8}
    assert sorted(r.doc_id for r in spark.read.parquet(f"{path}/dead/segment={state['segment']}").collect()) == [7, 8, 9]
    assert si.refresh(table(frame, docs), path)["version"] == state["version"]


def test_an_unpublished_segment_does_not_count_and_is_written_again(frame, spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "i"), made(60)
    si.build(table(frame, docs), path)
    before = contents(spark, path)
    docs[3] = ("late", "rare rare rare")
    with monkeypatch.context() as m:
        def stop(*args):
            raise RuntimeError("lost")

        m.setattr(si, "publish", stop)
        with pytest.raises(RuntimeError):
            si.refresh(table(frame, docs), path)
    assert contents(spark, path) == before
    si.refresh(table(frame, docs), path)
    assert contents(spark, path) == rebuilt(frame, spark, docs, tmp_path / "r")


def test_no_index_and_empty_index(frame, spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        si.state_of(spark, str(tmp_path / "none"))
    path = str(tmp_path / "i")
    si.build(table(frame, {}), path)
    assert si.live_postings(spark, path).count() == 0 and si.bm25(spark, path, "alpha").count() == 0
    si.refresh(table(frame, {1: (None, "alpha")}), path)
    assert [r.doc_id for r in si.bm25(spark, path, "alpha").collect()] == [1]


def plain_bm25(docs, query, holds, n, k1=1.2, b=0.75):
    bags = {}
    for i, fields in docs.items():
        bags[i] = {}
        for text, w in zip(fields, (1.0, 0.4)):
            for term in filter(None, map(normal_term, re.findall(r"[^\W_]+", (text or "").lower()))):
                bags[i][term] = bags[i].get(term, 0) + w
    N, mean = len(docs), sum(sum(x.values()) for x in bags.values()) / len(docs)
    terms = {t for a in search.parse_query(query) for o in a if o.wanted for t, _ in o.terms}
    idf = {t: math.log(1 + (N - df + 0.5) / (df + 0.5)) for t in terms for df in [sum(t in x for x in bags.values())] if df}
    scores = []
    for i, bag in bags.items():
        if holds(bag):
            s = sum(idf[t] * bag[t] * (k1 + 1) / (bag[t] + k1 * (1 - b + b * sum(bag.values()) / mean)) for t in terms if t in bag)
            scores.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(scores)[:n]]


@pytest.mark.parametrize("query, holds", [
    ("rare or common", lambda x: "rare" in x or "common" in x),
    ("payment alpha -zeta", lambda x: "payment" in x and "alpha" in x and "zeta" not in x),
    ("unknown", lambda x: "unknown" in x),
])
def test_bm25_equals_plain_scores(frame, spark, tmp_path, monkeypatch, query, holds):
    monkeypatch.setattr(si, "SLOT_DOCS", 8)
    monkeypatch.setattr(si, "FIRST_SLOTS", 3)
    path, docs = str(tmp_path / "i"), made(300)
    si.build(table(frame, docs), path)
    for i in range(0, 300, 40):
        docs[i] = ("rare", "payment alpha common")
    del docs[41]
    si.refresh(table(frame, docs), path)
    for listed in (10_000, 1):
        monkeypatch.setattr(si, "LISTED_SLOTS", listed)
        got = [(r.doc_id, r.score) for r in si.bm25(spark, path, query, 12).collect()]
        want = plain_bm25(docs, query, holds, 12)
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6)


def test_bounds_spare_blocks(frame, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(si, "SLOT_DOCS", 8)
    monkeypatch.setattr(si, "FIRST_SLOTS", 4)
    rng = random.Random(8)
    docs = {i: (None, " ".join(["common"] * rng.randrange(1, 4) + (["rare"] if i % 80 == 0 else []) + ["filler"] * rng.randrange(5, 40))) for i in range(1600)}
    path = str(tmp_path / "i")
    si.build(table(frame, docs), path)
    read, total = si.blocks_read(spark, path, "rare or common", 10)
    assert 0 < read < total / 3
    want = plain_bm25(docs, "rare or common", lambda x: True, 10)
    assert [r.doc_id for r in si.bm25(spark, path, "rare or common", 10).collect()] == [i for i, _ in want]


def test_unwanted_terms_alone_have_no_ranking(frame, spark, tmp_path):
    path = str(tmp_path / "i")
    si.build(table(frame, made(5)), path)
    with pytest.raises(ValueError):
        si.bm25(spark, path, "-alpha")


def test_building_shuffles_no_posting_by_document(frame, spark, tmp_path, monkeypatch):
    """Lengths and terms are known within the row: no stored table of the build is grouped or joined by document."""
    plans, write = [], si._write

    def noted(rows, path, kind, *rest, **more):
        plans.append((kind, rows._jdf.queryExecution().executedPlan().toString()))
        return write(rows, path, kind, *rest, **more)

    monkeypatch.setattr(si, "_write", noted)
    docs = {1: ("alpha note alpha", "alpha beta"), 2: (None, None), 3: ("Payment", "the terms"), 4: ("beta", "x")}
    si.build(table(frame, docs), str(tmp_path / "i"))
    assert {kind for kind, _ in plans} == {"docs", "postings", "blocks", "stats"}
    for kind, plan in plans:
        assert "Join" not in plan and "hashpartitioning(doc_id" not in plan and "collect_set" not in plan
        assert plan.count("Exchange") <= 2, (kind, plan)
    held = spark.read.parquet(str(tmp_path / "i" / "postings")).filter("doc_id = 1 and term = 'alpha'")
    # the weighted count of both fields is kept once
    assert sorted((r.field, r.tf, r.tenths) for r in held.collect()) == [("A", 2, 24), ("B", 1, None)]
    blocks = spark.read.parquet(str(tmp_path / "i" / "blocks")).filter("term = 'alpha'")
    assert [(r.n, r.most) for r in blocks.collect()] == [(1, 24)]
