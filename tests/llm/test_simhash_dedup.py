"""SimHash groups against all pairs, and the two rounds of variants on planted fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from pactframe.llm import simhash_dedup as sd
from pactframe.llm.components import components
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import EDGES, FOLDER


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest member reachable, for each of the given numbers, by comparing all pairs."""
    fps = sorted(fps)
    near = {f: [g for g in fps if (f ^ g).bit_count() <= 4] for f in fps}
    root = {}
    for f in fps:
        if f in root:
            continue
        seen, todo = {f}, [f]
        while todo:
            for g in near[todo.pop()]:
                if g not in seen:
                    seen.add(g)
                    todo.append(g)
        for g in seen:
            root[g] = f
    return root


def expected(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    root = plain_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return {i: (f"{f:016x}", least.get(root[f])) for i, f in fps.items()}


def test_query_equals_all_pairs(spark, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_dedup"](spark, FOLDER).collect()}
    assert got == expected(documents.items())


def test_edges_and_repeated_rows(docs):
    rows = sd.link_documents(docs(EDGES, "fingerprint")).collect()
    assert len(rows) == len(EDGES)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == expected(EDGES)


def test_empty_table(docs):
    assert sd.link_documents(docs([])).count() == 0 and sd.keep_one(docs([])).count() == 0


def signed(values):
    return [(int(np.uint64(v).astype(np.int64)),) for v in values]


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd):
    """Chains and dense balls of fingerprints; with a crowd of two most go through the round over all bits."""
    monkeypatch.setattr(sd, "CROWD", crowd)
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.choice([0, 1, 3, 30])):
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                f ^= 1 << b
            fps.add(f)
    df = spark.createDataFrame(signed(fps), "fp long")
    found = components(sd.links(df)).collect()
    groups, want = {}, {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node % 2**64)
    for f, r in plain_components(fps).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(n, 0) for n in range(61)} | {(100, 100), (101, 100)}


def test_keep_one(docs):
    text = " ".join(f"w{n}" for n in range(60))
    near = text.replace("w30", "x30")
    rows = [(9, text), (3, text), (3, text), (5, near), (7, "something else entirely is written here"), (None, text), (8, None), (2, "")]
    assert (plain_fingerprint(text) ^ plain_fingerprint(near)).bit_count() <= 64
    want = {c for i, (_, c) in expected([r for r in rows if r[0] is not None]).items()}
    kept = sd.keep_one(docs(rows))
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert kept.where("doc_id is null").count() == 1


def test_keep_one_tells_texts_of_one_key_apart(spark):
    clean, copied = "a clean text that no other row resembles in any way at all", "some other words that two rows of the table hold alike here"
    rows = [(3, copied), (5, copied), (5, clean), (5, clean), (None, copied), (7, None), (8, "")]
    kept = sd.keep_one(spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, hash string"))
    assert kept.columns == ["doc_id", "text", "hash"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, copied), (5, clean), (None, copied), (7, None)], key=repr)
