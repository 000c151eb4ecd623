"""Rule statistics against plain counting, the forest on planted outliers, and calibration."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from pactframe.llm import quality_forest as qf
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import EDGES, FOLDER, rows_of


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("ab \n\t#é\x1c\x85", max_size=120)))
def test_statistics_equal_plain_counts(text):
    assert qf.text_statistics(text.encode())[:5] == plain_counts(text)


def test_repeats_with_a_very_large_vocabulary():
    words = [f"w{n}" for n in range(9000)]
    text = " ".join(words + words[100:200] + ["z"] + words[5:9])
    assert qf.text_statistics(text.encode())[4] == plain_counts(text)[4] == 200


def test_query(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, FOLDER).collect()}
    assert rows.keys() == documents.keys()
    labels = dict(rows_of("labels", "doc_id, quality"))
    lost = kept_bad = 0
    for i, r in rows.items():
        counts = plain_counts(documents[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.kept and r.base_failed)
        lost += labels.get(i) == 1 and not r.kept and not r.base_failed
        kept_bad += labels.get(i) == 0 and r.kept
    assert lost == 0 and kept_bad <= 1


def test_forest_isolates_planted_outliers():
    rng = np.random.default_rng(1)
    points = np.r_[rng.normal(0, 1, (500, 3)), rng.normal(8, 1, (10, 3))]
    scores = qf.anomaly_scores(qf.grow_forest(points), points)
    assert scores[500:].min() > np.quantile(scores[:500], 0.98)


def test_usual_depth_is_that_of_a_search_tree():
    assert qf.usual_depth(1) == 0 and qf.usual_depth(2) == 1
    assert abs(qf.usual_depth(256) - 10.24) < 0.05


def judged(spark, docs, labels):
    return qf.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_edges_without_labels(spark, docs):
    out = judged(spark, docs(EDGES), [])
    assert out.columns[:2] == ["doc_id", "text"] and len(out.columns) == len(set(out.columns))
    rows = out.collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r.kept == (not r.base_failed)
        if not (r.text or "").strip():
            assert r.base_failed and r.n_words == 0


def test_null_labels_and_empty_tables(spark, docs):
    assert judged(spark, docs([]), [(1, 1, 0)]).count() == 0
    rows = judged(spark, docs(EDGES), [(None, 1, 0), (4, None, None), (5, 0, 0), (77, 1, 1)]).collect()
    assert len(rows) == len(EDGES)


def test_calibration_keeps_the_good(spark):
    scored = spark.createDataFrame(
        [(n, 0.3 + n / 1000, False) for n in range(100)] + [(n, 0.7 + n / 10_000, False) for n in range(100, 130)], "doc_id long, score double, base_failed boolean")
    labels = spark.createDataFrame([(n, int(n < 100)) for n in range(130)], "doc_id long, quality int")
    limit = qf.calibrate(scored, labels, "doc_id", 0.003)
    assert 0.399 < limit <= 0.7101
