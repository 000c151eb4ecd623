"""Decontamination against plain search, recall of the cosine search, reworded items, and edges."""

import random
import re

import numpy as np
import pytest

from pactframe.llm import lsi_decontam as ld
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import EDGES, FOLDER, rows_of


def plain_words(text):
    return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "


def test_query_finds_every_passage_and_nothing_else(spark, documents):
    items = {i: plain_words(t) for i, t in rows_of("benchmark")}
    want = {(d, i) for d, text in documents.items() for words in [plain_words(text)] for i, t in items.items() if t in words}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontamination"](spark, FOLDER).collect()}
    assert want and got == want


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEM = ("The committee of seven astronomers measured the orbital drift of comet Halvorsen over nineteen winters. "
        "Which instrument recorded the smallest deviation? The brass heliometer of Uppsala recorded it.")
FILL = [" ".join(f"plain{(n * k) % 97} filler{(n + k) % 89}" for k in range(1, 60)) for n in range(40)]


def found(spark, docs, texts, items=((1, ITEM),)):
    rows = [*enumerate(texts, 100), *enumerate(FILL)]
    return {(r.doc_id, r.item_id) for r in ld.find_items(docs(rows, "share"), bench(spark, list(items))).collect()}


def test_exact_reworded_and_unrelated(spark, docs):
    reworded = ITEM.replace("seven", "eight").replace("measured", "gauged").replace("smallest", "least")
    other = " ".join(reversed(ITEM.split()))
    half = " ".join(ITEM.split()[:10])
    texts = [f"{FILL[3]} {ITEM} {FILL[5]}", f"{FILL[3]}\n{reworded.upper()}\n{FILL[5]}", f"{FILL[3]} {other} {FILL[5]}", f"{FILL[1]} {half}", FILL[2], ITEM]
    assert found(spark, docs, texts) == {(100, 1), (101, 1), (105, 1)}


def test_an_item_without_its_answer_is_not_reported():
    words = ["q"] * 3
    assert ld.answer_of("Question one? The answer is here.") == "The answer is here."
    assert ld.answer_of("What? Answer: forty two") .strip() == "forty two"
    assert ld.answer_of(" ".join(words + ["a"] * 6)) == "a a a"


def test_common_weight_is_the_heaviest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, weight = rng.integers(0, 6, 8), rng.integers(0, 6, 9), rng.random(6)
        best = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + weight[x] if x == y else 0)
        assert ld.common_weight(a, b, weight) == pytest.approx(best[-1, -1])


def test_recall_of_the_latent_search_against_brute_force(spark, documents):
    """Windows that hold an item with words replaced: the cosine search against the exact check alone."""
    rng = random.Random(5)
    items = rows_of("benchmark")
    pool = [w for t in list(documents.values())[:60] for w in (t or "").split()]
    texts = []
    for _, t in items:
        for _ in range(5):
            words = [w if rng.random() > 0.1 else rng.choice(pool) for w in t.split()]
            texts.append(" ".join([*rng.choices(pool, k=40), *words, *rng.choices(pool, k=40)]).encode())
    df = spark.createDataFrame([(n, (t or "").encode()) for n, t in documents.items()], "doc long, raw binary")
    (((block, weight, space), _),) = ld.fitted(df, bench(spark, items), "item_id", "text", ld.RANK, ld.FIT_DOCUMENTS, ld.BLOCK_CHARS)
    finder = ld.Finder(block, weight, space)
    searched = finder.find_in(texts)
    finder.near = lambda terms, low, high, members: ((w, int(m), 1.0) for w in range(len(low)) if high[w] > low[w] for m in members)
    exact = finder.find_in(texts)
    want = {(n, f[0]) for n, fs in enumerate(exact) for f in fs}
    got = {(n, f[0]) for n, fs in enumerate(searched) for f in fs}
    assert got <= want and len(want) > 100
    assert len(got) >= 0.98 * len(want)


def test_blocks_of_the_benchmark_give_the_same(spark, documents):
    df = spark.createDataFrame(list(documents.items()), "doc_id long, text string")
    items = bench(spark, rows_of("benchmark"))
    one = ld.find_items(df, items).select("doc_id", "item_id").collect()
    many = ld.find_items(df, items, block_chars=4000).select("doc_id", "item_id").collect()
    assert sorted(one) == sorted(many)


def test_edges(spark, docs):
    items = bench(spark, [(1, ITEM), (2, None), (3, ""), (4, "..."), (None, "a null item id but with words that nobody else has written"), (1, ITEM)])
    rows = docs([*EDGES, (6, f"x {ITEM} y"), (6, f"x {ITEM} y")], "item_id")
    found = ld.find_items(rows, items)
    assert found.columns == ["doc_id", "item_id", "cosine", "share", "answer_share"]
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(6, 1), (6, 1)]
    clean = ld.without_items(rows, items)
    assert clean.columns == rows.columns and clean.count() == len(EDGES)


def test_empty_tables(spark, docs):
    assert ld.find_items(docs(EDGES), bench(spark, [])).count() == 0
    assert ld.find_items(docs([]), bench(spark, [(1, ITEM)])).count() == 0
    assert ld.without_items(docs(EDGES), bench(spark, [])).count() == len(EDGES)
    assert ld.without_items(docs([]), bench(spark, [(1, ITEM)])).count() == 0


def test_the_latent_space_is_fitted_on_all_documents(spark):
    """More documents than the former sample of 2,048, each a passage of its own."""
    words = ITEM.split()
    rows = spark.createDataFrame([(n, f"{n} {words[n % 9]} {words[n % 11]}".encode()) for n in range(5000)], "doc long, raw binary")
    block = ld.make_block([(1, ITEM)])
    lines = ld.numbered(rows, block, ld.FIT_DOCUMENTS)
    assert lines.where("fit").count() == 5000 and ld.numbered(rows, block, 100).where("fit").count() < 1000
    weight, matrix = np.ones(len(block.vocabulary)), np.random.default_rng(0).standard_normal((len(block.vocabulary), 4))
    passages = [p for r in lines.collect() for p in ld.passages_of(r.line)]
    assert np.allclose(ld.sketch(lines, block.words, weight, matrix), ld.gram_times(passages + block.words, weight, matrix))


def test_gram_times_equals_the_plain_product():
    rng = np.random.default_rng(3)
    weight, matrix = rng.random(300), rng.standard_normal((300, 7))
    passages = [np.minimum(rng.geometric(0.02, rng.integers(1, 60)), 299) for _ in range(500)]
    plain = np.zeros((500, 300))
    for n, ids in enumerate(passages):
        np.add.at(plain[n], ids, weight[ids])
        plain[n] /= np.linalg.norm(plain[n])
    assert np.allclose(ld.gram_times(passages, weight, matrix), plain.T @ (plain @ matrix))


@pytest.mark.parametrize("kind, keys", [("double", (1.5, -2.0)), ("decimal(20,3)", ("1.500", "7.000")), ("string", ("a", "b")), ("date", ("2024-01-01", "2024-02-01"))])
def test_item_keys_of_any_type(spark, docs, kind, keys):
    items = bench(spark, [(1, ITEM), (2, "another item whose words nobody has written so far")])
    named = items.selectExpr(f"cast(case item_id when 1 then '{keys[0]}' else '{keys[1]}' end as {kind}) as item_id", "text")
    found = ld.find_items(docs([(6, f"x {ITEM} y"), *enumerate(FILL, 10)]), named)
    assert dict(found.dtypes)["item_id"] == kind and [str(r.item_id) for r in found.collect()] == [str(keys[0])]


def test_windows_are_compared_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{n}" for n in rng.integers(0, 200, 3000)]
    block = ld.make_block([(1, " ".join(words[:900])), (2, " ".join(words[900:960]))])
    finder = ld.Finder(block, np.ones(len(block.vocabulary)), np.eye(len(block.vocabulary), 16, dtype=np.float32))
    texts = [" ".join(words).encode(), b"", " ".join(words[880:980]).encode()]
    want = finder.find_in(texts)
    monkeypatch.setattr(ld, "HITS", 1000)
    assert finder.find_in(texts) == want and {f[0] for f in want[0]} == {0, 1} and want[1] == []


def test_passages_of_many_lines_at_once(monkeypatch):
    monkeypatch.setattr(ld, "TOGETHER", 7)
    dice = random.Random(4)
    lines = [np.array([dice.choice([-1, -1, 0, 1, 2]) for _ in range(dice.choice([0, 1, 47, 48, 49, 300]))], "<i4").tobytes() for _ in range(600)]
    lines += [np.full(100, -1, "<i4").tobytes()]
    want, groups = [], []
    for line in lines:
        want += ld.passages_of(line)
        if len(want) >= 7:
            groups.append(want)
            want = []
    groups += [want] if want else []
    got = [[p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] for ids, sizes in ld.groups_of(iter(lines))]
    assert got == [[p.tolist() for p in g] for g in groups]


def test_near_windows_equal_plain_sums():
    dice = np.random.default_rng(3)
    words = [dice.integers(0, 50, 20).astype(np.int32) for _ in range(4)]
    block = ld.Block(list(range(4)), words, [w[-5:] for w in words], {str(n).encode(): n for n in range(50)})
    finder = ld.Finder(block, dice.random(50) + 0.1, dice.standard_normal((50, 8)).astype(np.float32))
    line = np.where(dice.random(400) < 0.4, dice.integers(0, 50, 400), -1)
    hits = np.flatnonzero(line >= 0)
    members, part = np.arange(4), np.array([0, 1, 2, 7, 30, 40])
    got = {(int(w), item): c for w, item, c in finder.near(line[hits], np.searchsorted(hits, part * 8), np.searchsorted(hits, part * 8 + 32), members)}
    want = {}
    for n, k in enumerate(part):
        inside = line[k * 8 : k * 8 + 32]
        image = finder.scaled[inside[inside >= 0]].sum(0)
        for item, c in enumerate(finder.queries @ image / np.linalg.norm(image)):
            if c >= ld.LEAST_COSINE:
                want[n, item] = c
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-5) and want
