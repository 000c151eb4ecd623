"""Vector links and components against all pairs."""

import numpy as np
import pytest

from pactframe.llm import vector_dedup as vd
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import FOLDER, rows_of

NAN, INF = float("nan"), float("inf")


def plain(rows):
    """(key, n_links, component, kept) of (key, vector, label) rows by all pairs."""
    unit = []
    for _, v, label in rows:
        x = None if label is None or not v or None in v or not np.isfinite(v).all() or not np.any(v) else np.array(v, np.float64)
        if x is not None:
            x = x / np.abs(x).max()
            x = x / np.linalg.norm(x)
        unit.append(x)
    near = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and rows[i][2] == rows[j][2]
             and len(a) == len(b) and a @ b >= 0.93] for i, a in enumerate(unit)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def got(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], f"vec_id long, embedding array<{kind}>, label int, kept string, class int")
    done = vd.near_duplicates(df)
    assert done.columns == ["vec_id", "label", "class", "n_links", "component_id", "kept"]
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in done.collect()), key=repr)


def near(rng, v, cosine):
    """A vector at a cosine from another."""
    w = rng.standard_normal(len(v))
    u = v / np.linalg.norm(v)
    w -= (w @ u) * u
    return cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def made(seed, dims=16, crowd=300, others=200):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(dims)
    rows = [near(rng, base, c) for c in rng.uniform(0.96, 1.0, crowd)]
    for _ in range(others):
        v = rng.standard_normal(dims)
        rows += [v, near(rng, v, rng.uniform(0.9, 0.97))]
    rows += [rows[0]] * 40 + [3 * rows[1]]
    return [(i, np.float32(v).tolist(), int(rng.integers(2))) for i, v in enumerate(rows)]


def test_query_equals_all_pairs(spark):
    rows = rows_of("embeddings", "vec_id, embedding, label")
    df = QUERIES["op11_vector_dedup"](spark, FOLDER)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, df.collect()), key=repr) == plain(rows)


def test_crowds_pairs_and_copies(spark):
    rows = made(5)
    assert got(spark, rows) == plain(rows)


def test_small_windows_blocks_and_parts(spark, monkeypatch):
    """Parts smaller than the window, and components of several blocks, change no count."""
    rows = made(6, others=40)
    monkeypatch.setattr(vd, "BLOCK", 50)
    monkeypatch.setattr(vd, "STEP", 16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    v, big = [1.0, 2.0, 3.0], [1e200, 2e200, 3e200]
    rows = [(1, v, 0), (2, v, None), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 3.0], 0), (7, [NAN, 1.0, 2.0], 0),
            (8, [INF, 1.0, 2.0], 0), (9, big, 0), (10, [-0.0, 1.0], 0), (11, [0.0, 1.0], 0), (12, [-1.0, -2.0, -3.0], 0), (13, v, 1),
            (14, v, 0), (14, v, 0), (None, v, 0), (None, [5.0, -1.0, 0.0], 0), (15, [1e-200, 2e-200, 3e-200], 0), (16, [7.0], 3), (17, [9.0], 3)]
    want = [(k, n, c, k == c) for k, n, c, _ in plain(rows)]
    assert got(spark, rows, "double") == sorted(want, key=repr)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("ends", [(0,), (10,), (50, 51, 52, 90), tuple(range(0, 120))])
def test_parts_find_what_one_stream_finds(spark, monkeypatch, ends):
    """The seams of a pass, with parts of any size, against one window over the whole order."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    raw = [np.float32(near(rng, base, 0.97)).tobytes() for _ in range(120)]
    form = np.dtype(np.float32)
    whole = vd.Forest(120)
    for i, j in vd.window_edges(["g"] * 120, raw, 0, form):
        whole.join(i, j)
    cut = vd.Forest(120)
    bounds = [0, *ends, 120]
    for a, b in zip(bounds, bounds[1:]):
        for i, j in vd.window_edges(["g"] * (b - a), raw[a:b], 0, form):
            cut.join(a + i, a + j)
    for s in ends:
        lo, hi = max(0, s - vd.WINDOW), min(120, s + vd.WINDOW)
        for i, j in vd.window_edges(["g"] * (hi - lo), raw[lo:hi], s - lo, form):
            cut.join(lo + i, lo + j)
    assert [whole.root(i) for i in range(120)] == [cut.root(i) for i in range(120)]
